"""Run detection, byte-level BPE and fill-in-middle against plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

CLASH = {"n": "long", "form": "string", "runs": "int", "start": "double", "n_units": "int", "prefix": "long", "ids": "int", "__t": "int", "__h": "string", "a": "int", "w": "string"}


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c, kind in CLASH.items():
        df = df.withColumn(c, F.lit("7").cast(kind))
    return df


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Runs


def plain_runs(w):
    """All maximal stretches with their smallest period, straight from the definition."""
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in out.items())


def plain_digest(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i if i is not None else "").encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(said), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def run_texts(seed=5):
    rng = random.Random(seed)
    word = lambda k: f"w{rng.randrange(k)}"
    out = [(1, None), (2, ""), (3, "  \n "), (4, "x " * 23), (5, "x " * 24), (6, "x " * 5000), (7, " ".join(word(3) for _ in range(3000)))]
    for i in range(60):
        parts = [word(200) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(1, 3)):
            q = rng.choice([1, 2, 3, 7, 8, 9, 10, 16, 17, 40])
            period = [word(rng.choice([2, 5, 500])) for _ in range(q)]
            length = max(24, 3 * q) + rng.randint(-2, 3 * q)
            parts += [period[k % q] for k in range(length)] + [word(200) for _ in range(rng.randint(0, 5))]
        if i % 5 == 0:
            parts += parts[:40]
        out.append((10 + i, " ".join(parts)))
    return out + [(77, out[-1][1]), (77, out[-1][1]), (None, out[20][1])]


def test_runs_equal_the_definition(spark):
    from gridloom.llm.periodic import looped, runs_digest

    rows = run_texts()
    got = sorted(map(tuple, runs_digest(looped(frame(spark, rows))).collect()), key=str)
    assert got == sorted((plain_digest(i, t) for i, t in rows), key=str)
    assert runs_digest(looped(frame(spark, []))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    from gridloom.llm.periodic import find_runs, least_overlap, repeated

    rng = random.Random(seed)
    assert least_overlap() == 16
    for _ in range(60):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 150))]
        w += w[: rng.randint(0, 60)] * rng.randint(0, 4)
        assert [tuple(r) for r in find_runs(w).tolist()] == sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
        x = np.array(w, np.int64)
        grams = [tuple(w[k : k + 16]) for k in range(len(w) - 15)]
        want = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 16)}
        assert set(np.flatnonzero(repeated(x, 16)).tolist()) == want


# Byte-level BPE


@pytest.fixture(scope="module")
def coder(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from gridloom.llm.byte_bpe import vocabulary

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return vocabulary(spark, path, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def bpe_texts(ranks, seed=3, n=150):
    rng = random.Random(seed)
    tokens = sorted(ranks)
    out = [None, "", " ", "\n\n  \t x", "don't we'LL", "a" * 3000, "<|endoftext|>", "é漢字😀 x　", "x" * 20000 + "y"]
    for k in range(n):
        if k % 4 == 0:
            out.append("".join(rng.choice("abcdefgh  '\n019-") for _ in range(rng.randint(1, 80))))
        elif k % 4 == 1:
            out.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x80, 0x7FF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(40)))
        elif k % 4 == 2:
            out.append(b"".join(rng.choice(tokens) for _ in range(8)).decode("utf-8", "replace"))
        else:
            out.append(base64.b64encode(rng.randbytes(30)).decode())
    return out


def test_bpe_equals_the_library(spark, coder):
    from gridloom.llm.byte_bpe import bpe_digest, decode_ids, encode_texts

    v, library, ranks = coder
    rows = [(k, t) for k, t in enumerate(bpe_texts(ranks))] + [(3, "again"), (3, "again"), (None, "no id")]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert sorted(map(tuple, bpe_digest(frame(spark, rows), v).collect()), key=str) == sorted(want, key=str)
    assert bpe_digest(frame(spark, []), v).count() == 0
    back = decode_ids(encode_texts(frame(spark, rows), v), v)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)


def test_bpe_prefixes_appends_and_edits(coder):
    from gridloom.llm.byte_bpe import Encoded, Encoder, merged

    v, library, ranks = coder
    e, rng = Encoder(v), random.Random(8)
    for text in bpe_texts(ranks, 4, 60)[1:8] + bpe_texts(ranks, 4, 60)[9:]:
        data = text.encode()[:60]
        last = e.last_tokens(data)
        for k in range(len(data) + 1):
            assert e.tokens_of(last[: k + 1]) == [ranks[p] for p in merged(data[:k], ranks)[0]]
        k = rng.randint(0, len(data))
        assert e.last_tokens(data, last[: k + 1]) == last
        kept = Encoded(e, text)
        for _ in range(5):
            a = rng.randint(0, len(kept.text))
            kept.edit(a, min(len(kept.text), a + rng.randint(0, 5)), "".join(rng.choice("ab  \n's1é") for _ in range(rng.randint(0, 6))))
            assert kept.ids() == library.encode_ordinary(kept.text)
        kept.append("  and more")
        assert kept.ids() == library.encode_ordinary(kept.text)
    long_ = Encoded(e, "some words of a text " * 3000)
    assert long_.edit(30_000, 30_003, "zz").ids() == library.encode_ordinary(long_.text) and long_.again < 12


def test_bpe_of_a_vocabulary_with_tokens_out_of_reach():
    from gridloom.llm.byte_bpe import Encoder, edges_of, merged

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([k]): k for k in range(256)}
    for k, t in enumerate([b"bc", b"ab", b"abc", b"xyz", b"aa", b"aaaa", b"abab", b"cab"]):
        ranks[t] = 256 + k
    v = edges_of(ranks, r"\S+|\s+")
    assert set(ranks.values()) - set(v.right) == {n for t, n in ranks.items() if merged(t, ranks)[0] != [t]} != set()
    e, rng = Encoder(v), random.Random(2)
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(500):
        t = "".join(rng.choice("abcxyz ") for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    with pytest.raises(ValueError):
        edges_of({b"a": 0}, r"\S+")


# Fill in the middle


def plain_middle(i, text):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (i, n, form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(t))


def test_middles_equal_the_definition(spark):
    from gridloom.llm.fill_middle import middle_digest

    texts = ["", None, "x", "\n\n", "😀" * 5, "a😀b😀́", "has <S> inside", "<P", "S><M", "x" * 2048, "x" * 2049, "ab😀" * 3000, "\x00  \r\n", "漢" * 700_000]
    rows = [(k + 100 * r, t) for r in range(3) for k, t in enumerate(texts[:-1])] + [(990, texts[-1]), (5, "twice"), (5, "twice"), (None, "no id at all")]
    got = sorted(map(tuple, middle_digest(frame(spark, rows)).collect()), key=str)
    assert got == sorted((plain_middle(i, t) for i, t in rows), key=str)
    assert middle_digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["WORDS", "LINES", "CHARACTERS"])
def test_units_are_kept_whole(spark, name, monkeypatch):
    import re

    from gridloom.llm import fill_middle as fm

    monkeypatch.setattr(fm, "CHUNK", 16)  # many chunks, with units across their edges
    units = getattr(fm, name)
    grammar = {"WORDS": r"\s+|\S+", "LINES": r"[^\n]*\n|[^\n]+", "CHARACTERS": r"(?s:.)"}[name]
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(["a", "b", " ", "\n", "long-unit-without-end" * 3, "😀"]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    out = {r.doc_id: r for r in fm.fill_in_middle(frame(spark, rows), units, plain_percent=0).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()}
    assert "__t" in out[0] and "start" in out[0]
    for i, t in rows:
        pieces, r = re.findall(grammar, t), out[i]
        assert r.back == t and r.n_units == len(pieces)
        if r.form != "plain":
            h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
            a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % (len(pieces) + 1) for k in range(2))
            assert (r.prefix, r.middle, r.suffix) == ("".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:]))
