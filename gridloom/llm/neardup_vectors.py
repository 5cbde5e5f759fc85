"""Near-duplicate vectors by spherical-cap filters.

A structured rotation (random signs and Hadamard steps) is followed by a random product code: the coordinates fall
into ``BLOCKS`` blocks with ``b`` random unit codewords each, and every combination of codewords is a filter
direction.  A vector is list-decoded to all directions whose inner product reaches a threshold; sums of two sorted
blocks are cut by bounds, so that only combinations near the threshold are looked at.  ``b`` follows the number of
vectors, so filters stay selective.  The threshold is that which ``LIST`` Gaussian directions reach; a vector that
fewer than ``LEAST`` directions reach takes its best ``LEAST``.

Vectors that share a filter (and the label and length) are compared in double precision by blocked matrix products.
A pair that shares several filters is counted in the smallest common one only, found by an incidence product, so
pairs are never written out: a filter gives counts for each vector and a spanning set of links.  Filters with many
vectors are split to pairs of chunks.  Equal vectors of a label are one weighted vector.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing; labels are compared as they are, of any type; components of any size up to the largest double;
vectors of different lengths are never compared; null vec_id gives a row with null component;
repeated rows are copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut, join_classes, join_one, mix, n_ranges

BLOCKS, LIST, LEAST, CHUNK = 4, 24, 16, 2048


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """d x d' matrix with orthonormal rows: two rounds of random signs and Hadamard steps on padded coordinates."""
    size = max(BLOCKS, 1 << (d - 1).bit_length())
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    rng = np.random.default_rng(seed)
    m = np.eye(size)
    for _ in range(2):
        m = m * rng.choice([-1.0, 1.0], size) @ (h / np.sqrt(size))
    return m[:d]


def code(d: int, b: int, seed: int = 11) -> np.ndarray:
    """BLOCKS x b codewords of length 1 / sqrt(BLOCKS)."""
    size = max(BLOCKS, 1 << (d - 1).bit_length()) // BLOCKS
    c = np.random.default_rng(seed + d).normal(size=(BLOCKS, b, size))
    return c / np.linalg.norm(c, axis=2, keepdims=True) / np.sqrt(BLOCKS)


def threshold(d: int, b: int) -> float:
    """The inner product that LIST of the b ** BLOCKS directions reach on average."""
    size = max(BLOCKS, 1 << (d - 1).bit_length())
    return NormalDist().inv_cdf(max(0.5, 1 - LIST / float(b) ** BLOCKS)) / np.sqrt(size)


def decode(scores: np.ndarray, t: float) -> np.ndarray:
    """All combinations (as numbers in base b) whose sum of block scores reaches ``t``, and the best LEAST at any rate.

    Where few directions point a vector's way its threshold is that of its own LEAST best directions.
    """
    b = scores.shape[1]
    left = (scores[0][:, None] + scores[1][None, :]).ravel()
    right = (scores[2][:, None] + scores[3][None, :]).ravel()
    order = np.argsort(-right)
    tail = right[order]
    k = min(LEAST, len(left))
    best = np.sort((-np.sort(-left)[:k, None] + tail[None, :k]).ravel())[-k]  # the k best sums are among these
    t = min(t, best)
    near = np.flatnonzero(left >= t - tail[0] - 1e-12)
    count = np.searchsorted(-tail, left[near] - t + 1e-12, side="right")
    a = np.repeat(near, count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return a.astype(np.int64) * b * b + order[k]


def _codes(b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            nodes, keys = [], []
            for node, label, raw in zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("vec").to_pylist()):
                x = np.frombuffer(raw, np.float64)
                d = len(x)
                if d not in made:
                    made[d] = (rotation(d), code(d, b), threshold(d, b))
                r, c, t = made[d]
                y = (x / np.linalg.norm(x)) @ r
                f = decode(np.einsum("ks,kbs->kb", y.reshape(BLOCKS, -1), c), t)
                nodes.append(node)
                keys.append(np.sort(mix(f.astype(np.uint64) * np.uint64(31) + mix(np.array([label], np.int64).view(np.uint64) + np.uint64(d))).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64()))], names=["node", "keys"])

    return run


def _compare(limit: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("ci", "ascending"), ("cj", "ascending"), ("node", "ascending")])
        bucket, ci, cj, chunk = (t.column(x).to_numpy() for x in ("bucket", "ci", "cj", "chunk"))
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        keys, vecs = t.column("keys").to_pylist(), t.column("vec").to_pylist()
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])
        cuts = np.append(np.flatnonzero(new), len(bucket))
        out_n, out_c, out_l = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = np.arange(a, b)
            left, right = rows[chunk[rows] == ci[a]], rows[chunk[rows] == cj[a]]
            if len(left) == 0 or len(right) == 0 or b - a < 2:
                continue
            links, root = np.zeros(b - a), np.arange(b - a)
            x = np.stack([np.frombuffer(vecs[i], np.float64) for i in rows])
            norm = np.linalg.norm(x, axis=1)
            lower = [[k for k in keys[i] if k < bucket[a]] for i in rows]
            for p in range(0, len(left), 512):
                for q in range(0, len(right), 512):
                    u, v = left[p : p + 512] - a, right[q : q + 512] - a
                    cos = (x[u] @ x[v].T) / (norm[u][:, None] * norm[v][None, :])
                    i, j = np.nonzero(cos >= limit)
                    i, j = i[u[i] < v[j]] if ci[a] == cj[a] else i, j[u[i] < v[j]] if ci[a] == cj[a] else j
                    if not len(i):
                        continue
                    both = np.unique(np.concatenate([u[i], v[j]]))
                    seen = [np.array(lower[k], np.int64) for k in both]
                    flat = np.concatenate(seen)
                    names, n = np.unique(flat, return_counts=True)
                    names = names[n >= 2]
                    inc = np.zeros((len(both), max(len(names), 1)), np.float32)
                    for k, s in enumerate(seen):
                        at = np.searchsorted(names, s)
                        ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == s) if len(names) else np.zeros(len(s), bool)
                        inc[k, at[ok]] = 1
                    ui, vi = np.searchsorted(both, u), np.searchsorted(both, v)
                    has_u, has_v = np.isin(u, both), np.isin(v, both)
                    shared = np.zeros((len(u), len(v)), bool)
                    shared[np.ix_(has_u, has_v)] = (inc[ui[has_u]] @ inc[vi[has_v]].T) > 0
                    first = ~shared[i, j]
                    np.add.at(links, u[i[first]], weight[rows[v[j[first]]]])
                    np.add.at(links, v[j[first]], weight[rows[u[i[first]]]])
                    join_classes(root, u[i], v[j])
            for k in np.flatnonzero((links > 0) | (root != np.arange(b - a))).tolist():
                out_n.append(int(node[a + k]))
                out_c.append(int(links[k]))
                out_l.append(int(node[a + root[k]]))
        return pa.table({"node": pa.array(out_n, pa.int64()), "n": pa.array(out_c, pa.int64()), "to": pa.array(out_l, pa.int64())})

    return run


def vector_components(vectors: DataFrame, min_cosine: float = 0.98) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label"))).alias("label"))
    fine = F.coalesce((F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(fine, F.xxhash64("label", "e")))
    rows = cut(rows)
    reps = cut(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("e").alias("e")))
    count = max(reps.count(), 1)
    b = max(4, int(np.ceil((64 * count) ** (1 / BLOCKS))))
    packed = reps.mapInArrow(_packed, "node long, label long, vec binary")
    coded = cut(packed.mapInArrow(_codes(b), "node long, keys array<long>"))
    at = coded.select("node", F.explode("keys").alias("bucket"))
    sizes = at.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    spots = cut(at.join(sizes, "bucket"))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 1
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    # A vector goes to a task once for each chunk of its filter.
    copies = spots.agg(F.sum(chunks)).first()[0] or 0
    parts = n_ranges(spark, copies * (8 * max(width, 1) + 300))
    dealt = spots.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.hash("node", "bucket"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", "bucket", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    data = packed.join(coded, "node").join(reps.select("node", "weight"), "node").select("node", "vec", "keys", "weight")
    dealt = dealt.join(data, "node").withColumn("part", F.pmod(F.hash("bucket", "ci", "cj"), F.lit(parts)))
    found = cut(dealt.groupBy("part").applyInArrow(_compare(min_cosine), "node long, n long, to long"))
    comp = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    per = reps.select("node", "weight", "least").join(counts, "node", "left").join(comp, reps.node == comp.id, "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("comp"))
    per = cut(per)
    least = per.groupBy("comp").agg(F.min("least").alias("component"))
    named = cut(join_one(per, least, "comp").select("node", "n_links", "component"))
    out = join_one(rows.select("vec_id", "node"), named, "node")
    cid = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # Scaled by a power of two, which changes no cosine, so that no square overflows or vanishes.
        vec = [np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes() for x in (np.array(e, np.float64) for e in b.column("e").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), pa.array(vec, pa.binary())], names=["node", "label", "vec"])
