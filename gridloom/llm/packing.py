"""Variable-capacity best-fit packing of documents into training sequences.

Token counts are whitespace words unless a column of counts is named.  A document longer than the largest permitted
length is cut to full sequences of that length and a rest.  The rests and the shorter documents are packed best fit,
longest first, jointly over the permitted lengths: an item goes to the open bin with the least room that holds it.  Where
none does, a bin is opened of the length with the least cost for a token that it is expected to hold: as many items of
this length as it takes, and of the smaller items still to be packed what fits in the rest of it.  The cost of a sequence is its
tokens, ``OVERHEAD`` for each and a share that grows with the square of its length (attention), 1 a token at ``QUADRATIC`` tokens.
At the end every bin is downsized to the smallest permitted length that holds its contents.

Best fit depends on lengths only, so it is decided on the histogram of lengths: at most ``max(capacities)`` counts
reach the driver, whatever the number of documents, and equal bins are handled as intervals of bin numbers.  Rows
then find their bins by rank within their length; ranks are made by salted partial counts, so a length that a third
of all rows have is no hot spot.

Edge cases: null, empty and wordless texts have no tokens and get bin -1; ties between equal lengths follow a hash
of the row, on any partitioning; repeated rows are items of their own; a text of any length is counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, keyed

CAPACITIES, OVERHEAD, QUADRATIC, MAX_BROADCAST = (512, 1024, 2048, 4096), 64, 8192, 200_000
#: Rows that a task ranks.
SALT_ROWS = 50_000


def bin_cost(capacity: int, overhead: int = OVERHEAD) -> float:
    """What a sequence of a permitted length costs, in tokens."""
    return overhead + capacity + capacity * capacity / QUADRATIC


def opened(length: int, todo: int, smaller, capacities, overhead: int) -> int:
    """The capacity with the least cost for an expected token, for ``todo`` items of ``length``.

    ``smaller(room)`` gives the tokens of items still to be packed that are not longer than ``room`` and than ``length``.
    """

    def cost(c: int) -> tuple[float, int]:
        per = min(c // length, todo)
        bins = -(-todo // per)
        held = min(todo * length + min(bins * (c - per * length), smaller(c - per * length)), bins * c)
        return bins * bin_cost(c, overhead) / held, c

    return min((c for c in capacities if c >= length), key=cost)


def plan(histogram: dict[int, int], capacities=CAPACITIES, overhead: int = OVERHEAD):
    """Best-fit decreasing on a histogram of lengths.

    Returns intervals (length, rank_from, rank_to, bin_from, per_bin, offset, capacity): the item of that length and
    rank r lies in bin ``bin_from + (r - rank_from) // per_bin`` at ``offset + (r - rank_from) % per_bin * length``.
    """
    caps = sorted(capacities)
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, number of bins, capacity)
    rooms: list[int] = []
    placed: list[tuple[int, int, int, int, int, int]] = []
    next_bin = 0
    # Tokens of all items up to each length; those longer than the one in hand are packed already.
    sizes = sorted(n for n in histogram if n > 0)
    upto = [0, *itertools.accumulate(n * histogram[n] for n in sizes)]

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in open_bins:
            bisect.insort(rooms, room)
        open_bins.setdefault(room, []).append(group)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        if length <= 0:
            continue
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                smaller = lambda room: upto[bisect.bisect_right(sizes, min(room, length - 1))]  # noqa: B023, E731
                cap = opened(length, todo, smaller, caps, overhead)
                n = -(-todo // (cap // length))
                put(cap, (next_bin, n, cap))
                next_bin += n
                continue
            room = rooms[at]
            first, n, cap = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            per = room // length
            full = min(n, todo // per)
            if full:
                placed.append((length, rank, rank + full * per, first, per, cap - room))
                put(room - per * length, (first, full, cap))
                rank, todo = rank + full * per, todo - full * per
                if n > full:
                    put(room, (first + full, n - full, cap))
            else:  # fewer items than one bin takes
                placed.append((length, rank, rank + todo, first, todo, cap - room))
                put(room - todo * length, (first, 1, cap))
                if n > 1:
                    put(room, (first + 1, n - 1, cap))
                rank, todo = rank + todo, 0
    final = sorted((first, n, cap - room) for room, groups in open_bins.items() for first, n, cap in groups)
    starts = [f[0] for f in final]
    out = []
    for length, a, b, first, per, offset in placed:
        i = bisect.bisect_right(starts, first) - 1
        while a < b:  # split where the contents, and so the final length, differ
            begin, n, used = final[i]
            end_bin = begin + n
            upto = min(b, a + (end_bin - first) * per)
            out.append((length, a, upto, first, per, offset, next(c for c in caps if c >= used)))
            first, a, i = end_bin, upto, i + 1
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+"))


def pack(docs: DataFrame, tokens: str | None = None, capacities=CAPACITIES, overhead: int = OVERHEAD, key: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, n_tokens, bin, bin_offset, capacity), one for each piece of each row of ``docs``.

    Pieces that fill a sequence have bins of their own, numbered from 0 above the packed ones, by (doc_id, piece).
    ``key`` names a column of numbers to take in place of doc_id.
    """
    top = max(capacities)
    n = word_count(F.col("text")) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    rows = docs.select(F.col(key or "doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n"), F.xxhash64("doc_id", "text" if tokens is None else tokens).alias("h"))
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0))
    rows = cut(rows.withColumn("last", last.cast("long")).withColumn("rest", F.col("n") - F.col("last") * top))
    # Rows of one id and hash are alike: they are counted and numbered anew, so that salts do not hang on partitions.
    salts = max(64, -(-rows.count() // SALT_ROWS))
    alike = rows.groupBy("doc_id", "n", "h", "last", "rest").agg(F.count("*").alias("c"))
    many = alike.select("*", F.explode(F.expr(f"sequence(0L, (c - 1) div {SALT_ROWS})")).alias("m"))
    rows = many.select("*", F.explode(F.expr(f"sequence(m * {SALT_ROWS}, least((m + 1) * {SALT_ROWS}, c) - 1)")).alias("k")).drop("c", "m")
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("h", "k"), F.lit(salts)).cast("int")))
    cells = rows.groupBy("rest", "salt").agg(F.count("*").alias("c"))
    # Bounded: one row for each length up to the largest and each salt.
    before = cells.withColumn("before", F.sum("c").over(Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r[0]: r[1] for r in cells.groupBy("rest").agg(F.sum("c")).collect() if r[0] > 0}
    steps = plan(histogram, capacities, overhead)
    spark = docs.sparkSession
    where = spark.createDataFrame(steps or [(0, 0, 0, 0, 1, 0, 0)], "rest long, a long, b long, first long, per long, off long, capacity long")
    where = F.broadcast(where) if len(steps) <= MAX_BROADCAST else where
    within = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("h", "doc_id", "k")) - 1
    ranked = rows.where("rest > 0").withColumn("w", within).join(before.select("rest", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["rest", "salt"]).withColumn("rank", F.col("w") + F.col("before"))
    packed = ranked.join(where, "rest").where("rank >= a and rank < b")
    packed = packed.select("doc_id", F.col("last").alias("piece"), F.col("rest").alias("n_tokens"), F.expr("first + (rank - a) div per").alias("bin"), F.expr("off + (rank - a) % per * rest").alias("bin_offset"), "capacity")
    none = rows.where("rest <= 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), F.lit(0).cast("long").alias("capacity"))
    base = max((s[3] + -(-(s[2] - s[1]) // s[4]) for s in steps), default=0)
    full = rows.where("last > 0")
    # One row for each salt.
    starts = full.groupBy("salt").agg(F.sum("last").alias("c")).select("salt", (F.sum("c").over(Window.orderBy("salt")) - F.col("c") + base).alias("start"))
    run = F.coalesce(F.sum("last").over(Window.partitionBy("salt").orderBy("h", "doc_id", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = full.withColumn("run", run).join(F.broadcast(starts), "salt").withColumn("bin0", F.col("start") + F.col("run")).select("doc_id", "bin0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", F.lit(top).cast("long").alias("n_tokens"), (F.col("bin0") + F.col("piece")).alias("bin"), F.lit(0).cast("long").alias("bin_offset"), F.lit(top).cast("long").alias("capacity"))
    return packed.unionByName(whole).unionByName(none)


def pack_texts(docs: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """``pack`` by words with the ``text`` of each piece: its words, with single blanks between."""
    rows, key = keyed(docs)
    top = max(capacities)
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\S+"), F.lit(0))
    packed = cut(pack(rows, capacities=capacities, overhead=overhead, key=key).withColumnRenamed("doc_id", key))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / top).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.slice("w", k * top + 1, top), " "))
    texts = rows.select(key, F.col("doc_id").cast("long").alias("doc_id"), words.alias("w")).select(key, "doc_id", F.posexplode(cuts).alias("piece", "text"))
    texts = texts.withColumn("piece", F.col("piece").cast("long")).groupBy(key, "piece").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return packed.join(texts, [key, "piece"]).select("doc_id", "piece", "n_tokens", "bin", "bin_offset", "capacity", "text")


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows (bin, capacity, n_tokens, doc_ids, text) of packed ``pieces``: a training sequence each, its pieces in order.

    A bin holds no more than its capacity, so a row is bounded; pieces without a bin are in none.
    """
    held = F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "text")))
    rows = pieces.where("bin >= 0").groupBy("bin").agg(F.max("capacity").alias("capacity"), F.sum("n_tokens").alias("n_tokens"), held.alias("p"))
    return rows.select("bin", "capacity", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.text", " ").alias("text"))
