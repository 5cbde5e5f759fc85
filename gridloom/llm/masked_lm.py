"""Masked pseudo-likelihood scores by a bidirectional window network trained in numpy.

Every word is predicted from ``SIDE`` words on either side: h = tanh(sum over places of a_place * E[word]), logits =
O h + b over the ``VOCAB`` most frequent words of the whole corpus and ``BUCKETS`` classes for the others.  Inside its class
a word is predicted from h as well: by a softmax over the words of the vocabulary in the class and one place for all others.
The vocabulary grows with the corpus, as ``GROWTH`` times the square root of the different words, so a class does too.  A
word outside it has log P(class) + log P(other | class) + log(n(word) / n(others of the class)), from the counts of all words.
On either side of a word, context is known by class.  The places inside the classes are fitted after the network, chunk by
chunk, on the h it gives; they do not change h.
A document's score is the sum of log P(word | both sides) over its words.

*Counts* of words cover all documents.  Texts are then *coded* once: the class numbers of their words, written to shared
storage, serve training and scoring.  *Training* is local stochastic gradient descent over all documents, dealt to groups
of about ``GROUP_WORDS`` words by a hash of (doc_id, text); a group passes its rows once, in the order of that hash, with
negatives that a batch shares (corrected by their sampling probability).  Groups train in ``ROUNDS`` rounds; those of a
round start from the average of the round before.  Weights are averaged by words in grouped steps (``GROUPS``), so the driver
gets one weight vector at any size.  Nothing of this depends on how the input is partitioned, so a task
that is run again gives the same scores.  *Scoring* uses the full softmax over whole texts.  The counts of at most
``LOCAL`` frequent words are sent to the tasks; all other words get theirs by a join.

Edge cases: null, empty and wordless texts have no words and score 0 with null per-word score; null doc_id is a row;
repeated rows are scored alike and train once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut
from gridloom.llm.decontaminate import words_of

VOCAB, BUCKETS, SIDE, DIM, NEGATIVES, BATCH, RATE = 192, 64, 3, 12, 48, 2048, 0.1
#: Weight vectors that are left after each step of averaging; the driver gets the last one.
GROUPS = (256, 16, 1)
ROUNDS, GROUP_WORDS = 2, 2_000_000
#: Words with a place of their own inside a class, over the square root of the number of different words.
GROWTH = 6
#: Words whose places inside the classes are scored, and fitted, at once.
CHUNK, INNER = 50_000, 20_000
SIZE = VOCAB + BUCKETS
PAD = SIZE
#: Words whose counts the tasks hold; a matter of speed only.
LOCAL = 100_000
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def code_type(wide: int):
    """The type of the numbers of words in classes of ``wide`` places."""
    return np.uint16 if wide * SIZE <= 1 << 16 else np.uint32


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all documents; pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(words_of(t))
            if len(c) > 200_000:
                yield flush(c)
                c.clear()
        yield flush(c)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def places(vocabulary: list[bytes]) -> list[int]:
    """Numbers of the words: class + ``SIZE`` times the place in the class; place 0 is a frequent word, or the other words of a class."""
    used, out = [0] * BUCKETS, []
    for i, w in enumerate(vocabulary):
        if i >= VOCAB:
            k = zlib.crc32(w) % BUCKETS
            used[k] += 1
            i = used[k] * SIZE + VOCAB + k
        out.append(i)
    return out


class _Numbers(dict):
    base = 0

    def __missing__(self, w: bytes) -> int:
        k = self[w] = self.base + VOCAB + zlib.crc32(w) % BUCKETS
        return k


class Coder:
    """Words to numbers of class and place, or to ``numbers``; a word that has none gets its class, plus ``base``."""

    def __init__(self, vocabulary: list[bytes], numbers=None, base: int = 0):
        self.ids = _Numbers(zip(vocabulary, places(vocabulary) if numbers is None else numbers))
        self.ids.base = base
        self.size = len(vocabulary)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > max(300_000, 2 * self.size):  # remembered rare words; the vocabulary comes first
            base, self.ids = self.ids.base, _Numbers(list(self.ids.items())[: self.size])
            self.ids.base = base
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))


def start(counts: np.ndarray, inner: np.ndarray) -> dict[str, np.ndarray]:
    """Weights at first; places in the classes start with their shares ``inner``, which stay as biases."""
    rng = np.random.default_rng(5)
    p = (counts + 1.0) / (counts + 1.0).sum()
    share = np.where(inner > 0, inner, 0.0)
    share[:, 0] += 1  # other words are never impossible
    bias = np.log(np.maximum(share, 1e-30) / share.sum(axis=1, keepdims=True)).astype("f4")
    return {"I": np.zeros((*inner.shape, DIM), "f4"), "ib": bias, "E": rng.normal(0, 0.3, (SIZE + 1, DIM)).astype("f4"), "A": np.ones((len(PLACES), DIM), "f4"), "O": rng.normal(0, 0.1, (SIZE, DIM)).astype("f4"), "b": np.log(p).astype("f4")}


def contexts(ids: np.ndarray) -> np.ndarray:
    """Class numbers around every position: (words, places)."""
    ids = ids % SIZE
    padded = np.concatenate([np.full(SIDE, PAD), ids, np.full(SIDE, PAD)])
    return np.stack([padded[SIDE + k : SIDE + k + len(ids)] for k in PLACES], axis=1)


def hidden(m: dict, ctx: np.ndarray) -> np.ndarray:
    total = np.take(m["E"] * m["A"][0], ctx[:, 0], axis=0)
    for k in range(1, len(PLACES)):
        total += np.take(m["E"] * m["A"][k], ctx[:, k], axis=0)
    return np.tanh(total, out=total)


def log_prob(m: dict, ids: np.ndarray) -> float:
    """Sum of log P(word | both sides) with the full softmax."""
    return log_probs(m, [ids])[0]


def _tame(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether the exponentials of w h + b, with h in -1 to 1, neither overflow nor all vanish in single precision."""
    s = np.abs(w).sum(axis=-1)
    return float((b + s).max()) < 60 and float((b - s).max(axis=-1).min()) > -60


def _log_sum(z: np.ndarray, tame: bool) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials, which take the place of ``z``."""
    top = 0.0 if tame else z.max(axis=1)
    if not tame:
        z -= top[:, None]
    return top + np.log(np.exp(z, out=z).sum(axis=1))


def _with_one(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)


def log_probs(m: dict, texts: list[np.ndarray]) -> list[float]:
    """``log_prob`` of several texts: classes text by text in blocks, places inside the classes together."""
    out, held, n = np.zeros(len(texts)), [], 0
    w, tame = np.concatenate([m["O"], m["b"][:, None]], axis=1).T, _tame(m["O"], m["b"])
    inner, calm = np.concatenate([m["I"], m["ib"][:, :, None]], axis=2).astype("f8").transpose(0, 2, 1), _tame(m["I"], m["ib"])
    for k, ids in enumerate(texts):
        cls, ctx = ids % SIZE, contexts(ids)
        for i in range(0, len(ids), 4096):
            h = _with_one(hidden(m, ctx[i : i + 4096]))
            at, z = cls[i : i + 4096], h @ w
            got = z[np.arange(len(z)), at]
            out[k] += float((got - _log_sum(z, tame)).sum(dtype=np.float64))
            if inner.shape[2] > 1:
                inside = np.flatnonzero(at >= VOCAB)
                held.append((h[inside], ids[i : i + 4096][inside], np.full(len(inside), k)))
                n += len(inside)
        if n > CHUNK or (n and k == len(texts) - 1):
            h, ids, text = map(np.concatenate, zip(*held))
            for c, at in by_class(ids):
                # Double products: the last digit does not depend on what else is in the chunk.
                z = (h[at].astype("f8") @ inner[c]).astype("f4")
                got = z[np.arange(len(z)), ids[at] // SIZE]
                np.add.at(out, text[at], (got - _log_sum(z, calm)).astype("f8"))  # word by word: the same sum in any chunk
            held, n = [], 0
    return out.tolist()


def by_class(ids: np.ndarray):
    """(class, positions of its words) for each class among words outside the most frequent ones."""
    k = ids % SIZE - VOCAB
    order = np.argsort(k.astype(np.uint16), kind="stable")
    ends = np.searchsorted(k[order], np.arange(BUCKETS + 1))
    return [(c, order[ends[c] : ends[c + 1]]) for c in range(BUCKETS) if ends[c] < ends[c + 1]]


def inner_step(m: dict, ids: np.ndarray, ctx: np.ndarray, rate: float) -> None:
    """One step of the places of every class, from the words (none of the most frequent) of a chunk."""
    seen, h, tame = m.setdefault("sqI", np.zeros(m["I"].shape, "f4")), _with_one(hidden(m, ctx)), _tame(m["I"], m["ib"])
    for c, at in by_class(ids):
        x = h[at]
        z = x @ np.concatenate([m["I"][c], m["ib"][c][:, None]], axis=1).T
        if not tame:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        x = x[:, :DIM]
        g = z.T @ (x / z.sum(axis=1)[:, None])  # what the places expect, less what they got
        np.subtract.at(g, ids[at] // SIZE, x)
        g /= len(at)
        seen[c] += g * g
        m["I"][c] -= rate * g / (np.sqrt(seen[c]) + 1e-6)


def train_step(m: dict, ids: np.ndarray, ctx: np.ndarray, rng, q: np.ndarray, rate: float) -> None:
    """One batch of sampled softmax: the word against shared negatives, logits corrected by log probability."""
    n = len(ids)
    h = hidden(m, ctx)
    neg = rng.choice(SIZE, NEGATIVES, p=q)
    lq = np.log(q * NEGATIVES + 1e-9).astype("f4")
    own = m["O"][ids]
    zn = h @ m["O"][neg].T + (m["b"][neg] - lq[neg])
    zn += np.where(neg == np.arange(SIZE)[:, None], np.float32(-1e4), np.float32(0))[ids]
    zp = np.einsum("nd,nd->n", h, own) + m["b"][ids] - lq[ids]
    top = np.maximum(zn.max(axis=1), zp)
    gn, gp = np.exp(zn - top[:, None]), np.exp(zp - top)
    total = gn.sum(axis=1) + gp
    gn /= total[:, None]  # gradients of the logits
    gp = gp / total - 1
    dh = (gn @ m["O"][neg] + gp[:, None] * own) * (1 - h * h)
    dims = np.arange(DIM)
    do = np.bincount((ids[:, None] * DIM + dims).ravel(), weights=(gp[:, None] * h).ravel(), minlength=SIZE * DIM).reshape(SIZE, DIM)
    np.add.at(do, neg, gn.T @ h)
    db = np.bincount(neg, weights=gn.sum(axis=0), minlength=SIZE) + np.bincount(ids, weights=gp, minlength=SIZE)
    de, da, flat = np.zeros((SIZE + 1, DIM)), np.zeros((len(PLACES), DIM)), dh.astype("f8").ravel()
    for k in range(len(PLACES)):  # sums of dh by the word at each place serve both gradients
        at = np.bincount((ctx[:, k, None] * DIM + dims).ravel(), weights=flat, minlength=(SIZE + 1) * DIM).reshape(SIZE + 1, DIM)
        de += at * m["A"][k]
        da[k] = (at * m["E"]).sum(axis=0)
    for k, g in (("O", do), ("b", db), ("E", de), ("A", da)):
        g = g / n
        seen = m.setdefault("sq" + k, np.zeros_like(g))  # steps shrink with the squared gradients seen so far
        seen += g * g
        m[k] -= (rate * g / (np.sqrt(seen) + 1e-6)).astype("f4")
    m["E"][PAD] = 0


def _shapes(wide: int) -> list[tuple[str, tuple[int, ...]]]:
    """Weights (classes of ``wide`` places) and, after them, the squared gradients that the steps of the next round go by."""
    shapes = [("E", (SIZE + 1, DIM)), ("A", (len(PLACES), DIM)), ("O", (SIZE, DIM)), ("b", (SIZE,)), ("I", (BUCKETS, wide, DIM))]
    return shapes + [("sq" + k, s) for k, s in shapes]


def _flat(m: dict) -> np.ndarray:
    return np.concatenate([np.asarray(m[k] if k in m else np.zeros(s)).ravel() for k, s in _shapes(m["I"].shape[1])]).astype("f8")


def _unflat(x: np.ndarray, bias: np.ndarray) -> dict:
    out, at = {"ib": bias}, 0
    for k, shape in _shapes(bias.shape[1]):
        n = int(np.prod(shape))
        out[k] = x[at : at + n].reshape(shape).astype("f8" if k.startswith("sq") and k != "sqI" else "f4")
        at += n
    return out


def _trained(model, q):
    def run(t: pa.Table) -> pa.Table:
        group, code = t.column("g")[0].as_py(), code_type(model["I"].shape[1])
        m, rng, last = {k: v.copy() for k, v in model.items()}, np.random.default_rng(group), None
        rows, pieces, held, seen = sorted(zip(t.column("key").to_pylist(), t.column("ids").to_pylist())), [], 0, 0

        def pass_over() -> int:
            ids = np.concatenate(pieces)
            ctx = np.concatenate([contexts(p) for p in pieces])
            order, cls = rng.permutation(len(ids)), ids % SIZE
            for i in range(0, len(ids), BATCH):
                at = order[i : i + BATCH]
                train_step(m, cls[at], ctx[at], rng, q, RATE)
            inside = order[cls[order] >= VOCAB] if m["I"].shape[1] > 1 else order[:0]
            for i in range(0, len(inside), INNER):
                at = inside[i : i + INNER]
                inner_step(m, ids[at], ctx[at], RATE)
            pieces.clear()
            return len(ids)

        for row in rows:
            if row == last:  # a repeated row
                continue
            last = row
            pieces.append(np.frombuffer(row[1], code).astype(np.int64))
            held += len(pieces[-1])
            if held > 200_000:
                seen, held = seen + pass_over(), 0
        if held:
            seen += pass_over()
        return pa.table({"g": pa.array([group], pa.int32()), "w": pa.array([_flat(m).tobytes()], pa.binary()), "n": pa.array([float(seen)])})

    return run


def _mean(rows: list[tuple[int, bytes, float]]) -> np.ndarray:
    """Average of weights by words, added in the order of the groups."""
    return sum(np.frombuffer(w, np.float64) * n for _, w, n in sorted(rows)) / sum(n for _, _, n in sorted(rows))


def _averaged(groups: int):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*[t.column(c).to_pylist() for c in ("g", "w", "n")]))
        return pa.table({"g": pa.array([rows[0][0] % groups], pa.int32()), "w": pa.array([_mean(rows).tobytes()], pa.binary()), "n": pa.array([sum(r[2] for r in rows)])})

    return run


def classes(counts: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The vocabulary; occurrences of its most frequent words and of the classes of all others; and of the places in each class."""
    rest = {r[0]: (r[1], r[2]) for r in counts.groupBy((F.crc32("word") % BUCKETS).alias("k")).agg(F.sum("n"), F.count("*")).collect()}
    many = VOCAB + math.ceil(GROWTH * math.sqrt(sum(r[1] for r in rest.values())))
    top = counts.orderBy(F.desc("n"), "word").limit(many).collect()  # grows with the square root of the different words
    vocabulary = [bytes(r[0]) for r in top]
    at = places(vocabulary)
    c, inner = np.zeros(SIZE), np.zeros((BUCKETS, max([k // SIZE for k in at], default=0) + 1))
    c[: min(len(top), VOCAB)] = [r[1] for r in top[:VOCAB]]
    for k, (n, _) in rest.items():
        c[VOCAB + k] += n
    for w, r in zip(vocabulary[:VOCAB], top):
        c[VOCAB + zlib.crc32(w) % BUCKETS] -= r[1]
    for k, r in zip(at[VOCAB:], top[VOCAB:]):
        inner[k % SIZE - VOCAB, k // SIZE] = r[1]
    inner[:, 0] = c[VOCAB:] - inner.sum(axis=1)
    return vocabulary, c, inner


def coded(docs: DataFrame, vocabulary: list[bytes], own: dict[bytes, float] | None = None, share: np.ndarray | None = None) -> DataFrame:
    """Rows (doc_id, key, n_words, ids, inside, rare): class numbers of the words, written once.

    ``inside`` is the sum of log(n(word) / n(class)) where ``own`` has it; the words in ``rare`` still lack log n(word).
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, own, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, share = sent.value
        coder, code = Coder(words), code_type(max(places(words), default=0) // SIZE + 1)
        if own is not None:  # one look-up a word: a row of these tables, or less than 0 for a word that lacks its count
            known = list(own)
            numbers, logs = coder(known), np.array(list(own.values()), float)
            rows = Coder(known, range(len(known)), -SIZE - 1)
        for b in batches:
            n, codes, sums, rare = [], [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                n.append(len(w))
                if own is None:
                    ids = coder(w)
                    sums.append(0.0)
                    rare.append([])
                else:
                    at = rows(w)
                    lost = np.flatnonzero(at < 0)
                    other = at[lost] + SIZE + 1
                    at[lost] = 0
                    ids, inside = (numbers[at], logs[at]) if len(numbers) else (at, np.zeros(len(at)))
                    ids[lost], inside[lost] = other, -share[other]
                    sums.append(float(inside.sum()))
                    rare.append([w[i] for i in lost.tolist()])
                codes.append(ids.astype(code).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(sums, pa.float64()), pa.array(rare, pa.list_(pa.binary()))], names=["doc_id", "key", "n_words", "ids", "inside", "rare"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return cut(rows.mapInArrow(run, "doc_id long, key long, n_words long, ids binary, inside double, rare array<binary>").withColumn("at", F.monotonically_increasing_id()))


def fit(rows: DataFrame, c: np.ndarray, inner: np.ndarray) -> dict:
    """Weights from all rows of ``coded``."""
    model, q = start(c, inner), (c + 1) ** 0.75
    q /= q.sum()
    words = rows.agg(F.sum("n_words")).first()[0] or 0
    groups = max(-(-words // GROUP_WORDS), 1)
    dealt = rows.where("n_words > 0").select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("g"), "key", "ids")
    shape = "g int, w binary, n double"
    for k in range(min(ROUNDS, groups)):
        got = dealt.where(F.col("g") % ROUNDS == k).groupBy("g").applyInArrow(_trained(model, q), shape)
        for n in GROUPS:
            got = got.groupBy(F.col("g") % n).applyInArrow(_averaged(n), shape)
        for r in got.collect():  # one row at most
            model = _unflat(np.frombuffer(r["w"], np.float64), model["ib"])
    return model


def train(docs: DataFrame, known: tuple[list[bytes], np.ndarray, np.ndarray] | None = None):
    """(vocabulary, weights) from all documents."""
    vocabulary, c, inner = known or classes(cut(count_words(docs)))
    return vocabulary, fit(coded(docs, vocabulary), c, inner)


def split_counts(counts: DataFrame) -> tuple[dict[bytes, int], DataFrame]:
    """Counts of at most ``LOCAL`` frequent words, and the rows (word, ln) of all others that occur more than once."""
    level = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):  # a few hundred rows
        total += r["n"]
        if total > LOCAL:
            break
        least = r["k"]
    if least is None:
        return {}, counts.where("n > 1").select("word", F.log("n").alias("ln"))
    near = counts.where(level >= least).select("word", "n").toArrow()  # at most LOCAL rows
    return dict(zip(near.column("word").to_pylist(), near.column("n").to_pylist())), counts.where((level < least) & (F.col("n") > 1)).select("word", F.log("n").alias("ln"))


def lm_scores(docs: DataFrame, trained=None) -> DataFrame:
    """Rows (doc_id, n_words, pll, pll_per_word) for every row of ``docs``."""
    counts = cut(count_words(docs))
    if trained:
        vocabulary, model = trained
        inside = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word binary")), "word", "left_anti")
        c = np.zeros(SIZE)
        for k, n in inside.groupBy((F.crc32("word") % BUCKETS).alias("k")).agg(F.sum("n")).collect():
            c[VOCAB + k] = n
    else:
        vocabulary, found, inner = classes(counts)
        c = np.concatenate([np.zeros(VOCAB), inner[:, 0]])
    near, far = split_counts(counts)
    share = np.log(np.maximum(c, 1))
    share[:VOCAB] = 0
    own = {w: math.log(n) - share[VOCAB + zlib.crc32(w) % BUCKETS] for w, n in near.items()} | dict.fromkeys(vocabulary, 0.0)
    rows = coded(docs, vocabulary, own, share)
    sent = docs.sparkSession.sparkContext.broadcast(model if trained else fit(rows, found, inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = code_type(sent.value["I"].shape[1])
            s = log_probs(sent.value, [np.frombuffer(x, code).astype(np.int64) for x in b.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s, pa.float64())], names=["doc_id", "at", "n_words", "s"])

    # Log counts of rare words (not held by the tasks) by a join; a word in ``far`` is by its choice not a frequent one.
    more = rows.select("at", F.explode("rare").alias("word")).join(far, "word").groupBy("at").agg(F.sum("ln").alias("more"))
    scored = rows.select("doc_id", "at", "n_words", "ids").mapInArrow(run, "doc_id long, at long, n_words long, s double")
    out = scored.join(rows.select("at", "inside"), "at").join(more, "at", "left")
    out = out.select("doc_id", "n_words", (F.col("s") + F.col("inside") + F.coalesce("more", F.lit(0.0))).alias("pll"))
    return out.withColumn("pll_per_word", F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words")))
