"""Runs of words with a period: found, and collapsed to their first period.

Method: k-gram masking.  Two copies of a run, one period apart, overlap in at least ``least_overlap`` words, so every word
of a run lies in a k-gram of that length which stands twice in its document.  All other words are masked; they cannot join
runs.  Main-Lorentz then goes over the segments between them only: at the centre of every dyadic block of a segment, each
period is followed to both sides by the longest common extension.  Extensions compare names of windows of 2**j words
(equal names, equal words), so nothing rests on hashes; these only show that a document has no repeated k-gram at all.

All pairs (centre, period) of a level are handled at once in numpy; a segment of n words takes O(n log n) memory and
O(n log^2 n) time.  A document is one row of one task.

Edge cases: a null or empty text has no words and no runs; a repeated row gives a row each time; an empty table gives an
empty result; only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix, powers

MIN_LENGTH, MIN_POWER = 24, 3


def least_overlap(min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> int:
    """The least number of words in which a run overlaps its own copy one period on."""
    return min(max(min_length, min_power * q) - q for q in range(1, min_length + 1))


def window_names(x: np.ndarray, upto: int) -> list[np.ndarray]:
    """names[j][i] is the same number for equal windows of 2**j words, for windows of at most ``upto`` words."""
    names = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(names) - 1) <= min(upto, len(x)):
        a, half = names[-1], 1 << (len(names) - 1)
        names.append(np.unique(a[:-half] * np.int64(len(x) + 1) + a[half:], return_inverse=True)[1].astype(np.int64))
    return names


def repeated(x: np.ndarray, k: int) -> np.ndarray:
    """Mask of the words that lie in a k-gram which occurs again in ``x``."""
    out = np.zeros(len(x), bool)
    if len(x) <= k:
        return out
    with np.errstate(over="ignore"):
        h = np.zeros(len(x) + 1, np.uint64)
        p, q = powers(len(x) + 1)
        np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * p[:-1], out=h[1:])
        grams = np.sort((h[k:] - h[:-k]) * q[: len(x) - k + 1])
    if not (grams[1:] == grams[:-1]).any():
        return out
    names = window_names(x, k)
    top = 1 << (len(names) - 1)
    pairs = names[-1][: len(x) - k + 1] * np.int64(len(x) + 1) + names[-1][k - top :]
    _, at, count = np.unique(pairs, return_inverse=True, return_counts=True)
    first = np.flatnonzero(count[at] > 1)
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + k, -1)
    return np.cumsum(edge[:-1]) > 0


class Extensions:
    """Longest common extensions of pairs of places in one sequence."""

    def __init__(self, x: np.ndarray):
        self.n, self.names = len(x), window_names(x, len(x))

    def same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the windows of 2**level words at i and j lie inside and are equal."""
        name = self.names[level]
        inside = (i >= 0) & (j >= 0) & (i < len(name)) & (j < len(name))
        return inside & (name[np.where(inside, i, 0)] == name[np.where(inside, j, 0)])

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            got += self.same(level, i + got, j + got).astype(np.int64) << level
        return got

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            got += self.same(level, i - got - (1 << level), j - got - (1 << level)).astype(np.int64) << level
        return got


def segment_runs(x: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``x``: maximal, with their smallest period.

    A run lies in a smallest dyadic block, whose centre it crosses; on one side of it at least a period of the run stands.
    """
    found = [np.zeros((0, 3), np.int64)]
    ext = Extensions(x)
    quick = max(0, min(len(ext.names) - 1, (least_overlap(min_length, min_power) // 2).bit_length() - 1))
    half = 1
    while half < len(x):
        if 2 * half >= min_length:
            centres = np.arange(half, len(x), 2 * half)
            periods = np.arange(1, 2 * half // min_power + 1)
            c, q = (g.ravel() for g in np.meshgrid(centres, periods, indexing="ij"))
            for left, right in ((c, c + q), (c - q, c)):
                # The overlap stretches over half its least length to one side of the centre.
                ok = ext.same(quick, left, right) | ext.same(quick, left - (1 << quick), right - (1 << quick))
                a, b, p = left[ok], right[ok], q[ok]
                f, g = ext.after(a, b), ext.before(a, b)
                long_ = f + g + p >= np.maximum(min_length, min_power * p)
                found.append(np.stack([(a - g)[long_], (f + g + p)[long_], p[long_]], axis=1))
        half *= 2
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period: multiples of a period come after it
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(words: list, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text's words, by start, then period."""
    out = [np.zeros((0, 3), np.int64)]
    if len(words) >= min_length:
        number: dict = {}
        x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        mask = np.concatenate([[False], repeated(x, least_overlap(min_length, min_power)), [False]])
        edges = np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= min_length].tolist():
            out.append(segment_runs(x[a:b], min_length, min_power) + np.array([a, 0, 0]))
    return np.concatenate(out)


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        runs, texts = [], []
        for t in b.column("text").to_pylist():
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            got = find_runs(words)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in got.tolist()])
            texts.append(b" ".join(collapsed(words, got)).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "text"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, text): all runs of at least ``MIN_LENGTH`` words and ``MIN_POWER`` periods, and the text without
    the words after their first periods (words joined by one space)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def looped(docs: DataFrame) -> DataFrame:
    """A tenth of the texts (by the crc32 of the id) repeat a stretch of their words to the end; others stay as they are."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    some = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at), " "))
    return some.select("doc_id", text.alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest length over period (ties: smallest start, then period) and digests."""
    none = F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])  # noqa: E731 - runs come by start and period
    out = collapse_runs(docs).withColumn("best", F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a)))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("best")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
