"""Toxicity in context, the automaton of decontamination, and packing on any partitioning."""

import os
import random

import numpy as np
import pytest

from tests.llm import brute

DATA = "/root/testdata"


def toxic_corpus(seed=1, n=400):
    """Texts of which a third hold terms of abuse, quoted in some that are clean."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["vermint", "scumbeast", "wretchling", "grubface", "lowlifer", "trashking"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(15, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 18 == 1:
            words.insert(len(words) // 2, f'he said "{rng.choice(bad)}"')
        rows.append((" ".join(words), int(toxic)))
    return rows, plain, bad


def plain_features(match, text):
    """The features again, from their definition, with a list of positions for each kind."""
    from gridloom.llm import toxicity as tx

    words = tx.WORD.findall((text or "").lower())
    hits = [(i, w, *match(w)) for i, w in enumerate(words) if match(w)[0]]
    near = lambda i: words[max(0, i - tx.WINDOW) : i] + words[i + 1 : i + tx.WINDOW + 1]

    def quoted(i, w):
        before, after = words[max(0, i - tx.WINDOW) : i], words[i + 1 : i + tx.WINDOW + 1]
        return (set(before) & tx.QUOTES and set(after) & tx.QUOTES) or (set(near(i)) | {w}) & tx.CUES

    bare = [h for h in hits if not quoted(h[0], h[1])]
    count = lambda k: sum(h[2] == k for h in bare)
    said = [count(1), count(2), count(3), len(hits) - len(bare), len({h[1] for h in bare}), sum(h[3] for h in bare), 1000 * len(bare) / max(len(words), 1), sum(bool((set(near(h[0])) | {h[1]}) & tx.ADDRESS) for h in bare)]
    return [1.0, *np.log1p(said)]


def test_features_equal_their_definition():
    from gridloom.llm import toxicity as tx

    rows, _, bad = toxic_corpus()
    match = tx.Matcher(tx.lexicon(rows))
    texts = [t for t, _ in rows] + [None, "", '"vermint"', "you vermimt and scumbeast", 'she wrote "vermint you" to me', "vermint " * 500]
    for t in texts:
        assert np.allclose(tx.features(match, t), plain_features(match, t))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotation_lowers_and_misspelling_raises(seed):
    from gridloom.llm import toxicity as tx

    rows, plain, bad = toxic_corpus(seed)
    model = tx.ToxicityModel.fit(rows)
    match = tx.Matcher(model.terms)
    score = lambda t: float(1 / (1 + np.exp(-np.array(tx.features(match, t)) @ model.weights)))
    base = " ".join(plain[:20])
    known = [t for t in bad if match(t)[0]]
    assert len(known) >= 3
    for term in known:
        bare, said = score(f"{base} {term} {base}"), score(f'{base} she wrote "{term}" there {base}')
        wrong = term[:3] + "x" + term[4:]
        assert said < bare and score(base) < score(f"{base} {wrong} {base}") and score(base) < bare and bare > 0.5
    assert (model.weights * tx.SIGNS >= 0).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quotation_on_the_tables(spark, sf):
    from gridloom.llm import toxicity as tx

    if not os.path.exists(f"{DATA}/{sf}"):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{DATA}/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fitted(docs, labels)
    match = tx.Matcher(model.terms)
    score = lambda t: float(1 / (1 + np.exp(-np.array(tx.features(match, t)) @ model.weights)))
    base = "one plain line about trains and weather in the north of the country"
    strong = [t for t, _, stem, _ in sorted(model.terms, key=lambda x: -x[1]) if not stem and len(t) >= 5][:6]
    assert strong
    for term in strong:
        bare = score(f"{base} {term} {base}")
        assert score(f'{base} "{term}" {base}') < bare and score(base) < bare
        assert score(base) <= score(f"{base} {term[:2]}q{term[3:]} {base}")


def test_long_labelled_texts_are_fitted_by_passages(spark, monkeypatch):
    from gridloom.llm import toxicity as tx

    monkeypatch.setattr(tx, "MAX_TRAIN_BYTES", 3200)
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choice(["scumbeast", "vermint"]) if bad and rng.random() < 0.2 else rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(2000))
    rows = [(i, text(i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in tx.toxicity(docs, labels).collect()}
    assert got == {i: i % 2 for i, _ in rows}
    assert all(len(r.text.encode()) <= 3300 for r in tx.training_rows(docs, labels).collect())


# Decontamination


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_brute_force(spark, seed, monkeypatch):
    from gridloom.llm import decontaminate as dc

    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 40]))) for k in range(12)] + [(None, text(12)), (99, None), (5, text(15))]
    docs = [(k, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") if k % 3 else text(30).replace(" ", ", ")) for k in range(60)]
    docs = [(i, t if t is None or rng.random() < 0.9 else t.upper()) for i, t in docs] + [(70, None), (71, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.decontaminate(docs, items), key=str)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, dc.find_contamination(d, b).select(cols).collect()), key=str) == want
    monkeypatch.setattr(dc, "ITEM_WORDS", 7)  # items are cut to pieces
    assert sorted(map(tuple, dc.find_contamination(d, b, 40).select(cols).collect()), key=str) == want


def test_two_benchmarks_of_one_size_in_one_session(spark):
    from gridloom.llm.decontaminate import find_contamination

    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "k j i h g f e d c b a")], "doc_id long, text string").coalesce(1)
    for limit in (1000, 3):
        for item, hit in (("a b c d e f g h i j", 1), ("k j i h g f e d c b", 2)):
            bench = spark.createDataFrame([(1, item)], "item_id long, text string")
            assert [r.doc_id for r in find_contamination(docs, bench, limit).where("contaminated").collect()] == [hit]


# Packing


def test_packing_is_the_same_on_any_partitioning(spark):
    from gridloom.llm.packing import pack

    rng = random.Random(3)
    rows = [(k % 170, " ".join("w" for _ in range(rng.choice([3, 50, 51, 700, 5000])))) for k in range(250)] + [(7, "same row of words")] * 40 + [(None, "x y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = [sorted(map(tuple, pack(df.repartition(n)).collect()), key=str) for n in (1, 3, 7)]
    assert some[0] == some[1] == some[2]
