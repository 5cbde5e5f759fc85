"""What the corpus operators share: table access, shared scratch tables, binary blocks and word hashing.

*Blocks*: operators that move hundreds of millions of small fixed-width records (shingle hashes, anchors) do not
make a Spark row of each.  Every Arrow batch sorts its records by a hash range and emits one binary value for each
range, so that the shuffle carries few rows and the reducers work on numpy arrays.  The number of ranges follows
the amount of data, so a range fits in a task's memory at any size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.scratch import cut

#: A 64-bit odd multiplier of the splitmix finaliser.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of (doc_id, text) in a column of an unused name: decisions on texts also reach rows without an id."""
    name = unused(docs, "__key")
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))), name


#: Entries of a chunk in running totals.
CHUNK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op) -> Column:
    """For each entry of an array of ints, 0 and all entries before it under ``op``.

    In chunks of ``CHUNK``: appending to one array would copy it for each entry of a long text.
    """
    start = lambda z: F.struct(z.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, v: F.struct(op(acc.at, v).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
    total = lambda x: F.aggregate(x, F.lit(0), op)
    n = F.floor((F.size(values) + CHUNK - 1) / CHUNK).cast("int")
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.expr("cast(array() as array<array<int>>)"))

    def joined(x: Column) -> Column:
        firsts = F.aggregate(F.transform(x, total), start(F.lit(0)), step, lambda acc: acc.out)
        return F.flatten(F.transform(F.arrays_zip(x.alias("x"), firsts.alias("first")), lambda z: F.aggregate(z.x, start(z.first), step, lambda acc: acc.out)))

    return let(chunks, joined)


def n_ranges(spark: SparkSession, total_bytes: int, per_task: int = 24 << 20) -> int:
    """How many hash ranges keep a task's share of ``total_bytes`` near ``per_task`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // per_task), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(p: int, n: int) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64 by doubling."""
    out = np.ones(1, np.uint64)
    step = np.uint64(p)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:n]


P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        _cache["p"], _cache["q"] = _powers(P, max(n, 1 << 16)), _powers(P_INV, max(n, 1 << 16))
    return _cache["p"][:n], _cache["q"][:n]


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hash(data: bytes) -> np.ndarray:
    """H with H[e] - H[s] = sum of b[j] * P**j over s <= j < e (modulo 2**64)."""
    codes = BYTE_CODES[np.frombuffer(data, np.uint8)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes * powers(len(data))[0], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end): equal strings have equal hashes wherever they stand."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words: the whole sequence as one; none: empty."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = prefix_hash(b" ".join(words))
    k = min(width, len(words))
    return np.unique(span_hash(h, starts[: len(words) - k + 1], ends[k - 1 :]))


def scatter(key: np.ndarray, ranges: int, *cols: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Deal records to ``ranges`` by ``key``: the ranges that got any, and for each column the bytes for them."""
    part = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    got = [int(part[a]) for a in cuts[:-1]]
    out = []
    for c in cols:
        c = c[order]
        out.append([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
    return got, out


def gather(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def join_classes(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of the pairs (a, b) in ``root``, which holds the least member of each member's class."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (next_ := root[root]).tobytes() != root.tobytes():
            root[:] = next_


def small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint for a written table whose row count is checked to be at most ``limit``; else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_one(left: DataFrame, right: DataFrame, key: str, rows: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Left join to ``right``, which has one row for a key; no task gets all rows of a frequent key.

    Keys that more than 1000 rows and a ten thousandth of all rows hold (so 10,000 keys at most) are joined by
    broadcast, rows without a key by none.  ``left`` is read several times; ``counts`` may give its rows (key, c).
    """
    rows = left.count() if rows is None else rows
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c")) if counts is None else counts
    heavy = cut(counts.where(F.col("c") > max(1000, rows // 10_000)).select(key))
    none = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key])
    if not heavy.limit(1).count():
        return left.where(F.col(key).isNotNull()).join(right, key, "left").unionByName(none)
    heavy = F.broadcast(heavy)
    some = left.join(heavy, key, "left_semi").join(F.broadcast(right.join(heavy, key, "left_semi")), key, "left")
    rest = left.where(F.col(key).isNotNull()).join(heavy, key, "left_anti").join(right, key, "left")
    return some.unionByName(rest).unionByName(none)


#: Links of a graph that one task joins: 16 bytes each.
SMALL_GRAPH = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if ends:
        u, v = (np.concatenate(x) for x in zip(*ends))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = np.arange(len(names))
        join_classes(root, at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["id", "component"])


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Smallest id reachable by undirected ``links`` (a, b): rows (id, component) for every id that has a link.

    Up to ``SMALL_GRAPH`` different links (counted first) are joined in one task.  Beyond, alternating large-star and
    small-star steps; each step is a grouped minimum and one join, written to scratch space so that lineage stays
    short.  Nothing is collected but one row of counts a round.  The steps go on until nothing changes; with
    ``rounds`` it is an error if something still does after them.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if rounds is None and e.count() <= SMALL_GRAPH:
        return e.coalesce(1).mapInArrow(_contracted, "id long, component long")
    state = last = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
        both = e.union(e.select("v", "u"))
        m = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")))
        near = join_one(both, m.select("u", "m"), "u", rows=2 * state[0] if state else None, counts=m.select("u", "c"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(m.where("m < u").select("u", "m")).where("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m2.select("u", "m")).where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == last:
            break
        last = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct()).groupBy("id").agg(F.min("component").alias("component"))
