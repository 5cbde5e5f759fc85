"""Matrices made from analytical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 incidence B of orders and parts."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).distinct().withColumn("v", F.lit(1.0))


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights w_ij: orders that hold both parts."""
    b = order_parts(spark, sf_dir)
    return b.select("i", F.col("j").alias("p")).join(b.select("i", F.col("j").alias("q")), "i").where("p <> q").groupBy("p", "q").agg(F.count("*").cast("double").alias("v")).toDF("i", "j", "v")


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L = D - W + I of the co-purchase graph on all parts that were ordered: symmetric and diagonally dominant.

    An order of n parts adds n - 1 to their diagonals and -1 to their pairs, so the entries are made in one pass, where
    their columns are dealt: a list of the order's parts moves there, not its pairs.  ``cut_by`` the column needs no
    further shuffle.
    """
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("j")).repartition(many, "o")
    orders = lines.groupBy("o").agg(F.collect_set("j").alias("with"))
    ends = orders.select("o", F.explode("with").alias("j"), "with").withColumn("with", F.when(F.col("o").isNull(), F.array("j")).otherwise(F.col("with")))  # no order: no pair
    e = ends.select("j", "with").repartition(many, "j").select(F.explode("with").alias("i"), "j", F.size("with").alias("n"))
    one = e.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("n") - 1).otherwise(-1).alias("v"))
    return one.groupBy("i", "j").agg(F.sum("v").cast("double").alias("v")).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") + 1.0).otherwise(F.col("v")).alias("v"))


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


#: Parts of a shelf, and of a block of five shelves.
SHELF, SHELF_BLOCK = 10, 50
#: Parts are numbered from 0, nodes of grids from 1.
NODE = "p_partkey + 1 AS i"


def shelf(spark: SparkSession, sf_dir: str, skew: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(A, rhs) of diffusion between parts that stand side by side, or one above the other, on shelves of ``SHELF`` parts.

    The conductance of two neighbours is the mean of what was ordered of either (1 + quantity / 100); the diagonal is 1.5
    times the sum of the conductances and a tenth of the part's size, the right-hand side its price.  With ``skew`` the
    flow to higher numbers is stronger than back: the matrix is not symmetric.
    """
    sold = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 1).alias("i")).agg(F.sum("l_quantity").alias("q"))
    part = read(spark, sf_dir, "part").selectExpr(NODE, "p_size AS size", "p_retailprice AS price")
    nodes = part.join(sold, "i", "left").select("i", "size", "price", (1.0 + F.coalesce("q", F.lit(0.0)) / 100.0).alias("c"))
    at, beside = F.col("i"), F.col("k")
    ends = nodes.select("i", F.col("c").alias("ci"), F.explode(F.array(*[F.lit(k) for k in (-SHELF, -1, 1, SHELF)])).alias("k"))
    ends = ends.where(~((beside == 1) & (at % SHELF == 0)) & ~((beside == -1) & (at % SHELF == 1))).select("i", (at + beside).alias("j"), "ci")
    w = ends.join(nodes.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j").select("i", "j", ((F.col("ci") + F.col("cj")) / 2).alias("w"))
    off = w.select("i", "j", (-F.col("w") * F.when(F.col("j") > F.col("i"), 1.0 + skew).otherwise(1.0 - skew)).alias("v"))
    on = nodes.join(w.groupBy("i").agg(F.sum("w").alias("s")), "i", "left").select("i", F.col("i").alias("j"), (1.5 * F.coalesce("s", F.lit(0.0)) + F.col("size") / 10.0).alias("v"))
    return off.unionByName(on), nodes.select("i", F.col("price").alias("v"))


def shelf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition (i, blk) of the parts: five shelves a block."""
    return read(spark, sf_dir, "part").selectExpr(NODE, f"cast(p_partkey div {SHELF_BLOCK} as int) AS blk")


def part_nodes(spark: SparkSession, sf_dir: str, dim: int) -> tuple[DataFrame, int]:
    """Parts as the nodes (i, size, price) of the largest grid of ``dim`` axes that they fill, and its nodes along an axis."""
    part = read(spark, sf_dir, "part").selectExpr(NODE, "p_size AS size", "p_retailprice AS price")
    n, side = part.count(), 0
    while (side + 1) ** dim <= n:
        side += 1
    return part.where(F.col("i") <= side**dim), side


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count("*").cast("double").alias("v"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonsymmetric counts of consecutive event types of users (types numbered by name from 1)."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = e.select("event_type", nxt.alias("n")).where("n is not null").groupBy("event_type", "n").agg(F.count("*").cast("double").alias("v"))
    names = F.broadcast(e.select("event_type").distinct().withColumn("k", F.rank().over(Window.orderBy("event_type")).cast("long")))  # few types
    a = names.select(F.col("event_type"), F.col("k").alias("i"))
    b = names.select(F.col("event_type").alias("n"), F.col("k").alias("j"))
    return pairs.join(a, "event_type").join(b, "n").select("i", "j", "v")


#: Dot products that a task holds at a time.
CELLS = 500_000


def close_vectors(rows: DataFrame, queries: DataFrame, limit: float, block: int = 8192) -> DataFrame:
    """Dot products (i, j, v) above ``limit`` times both norms, of all ``rows`` (i, e) with the ``queries`` (i, e).

    The queries go to the tasks in blocks of about ``block`` vectors, one broadcast each; rows are never shuffled.  Vectors of another length than
    the query have no entry.
    """
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    parts = max(1, -(-queries.count() // block))
    out = None
    for p in range(parts):
        some = queries.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).toArrow()  # ``block`` vectors, about
        held: dict[int, tuple] = {}
        for i, e in zip(some.column("i").to_pylist(), some.column("e").to_pylist()):
            held.setdefault(len(e), ([], []))[0].append(i)
            held[len(e)][1].append(e)
        sent = spark.sparkContext.broadcast({n: (np.array(ids), np.array(vecs, float)) for n, (ids, vecs) in held.items()})

        def run(batches, sent=sent):
            for b in batches:
                ids, vecs = b.column("i").to_numpy(), b.column("e").to_pylist()
                for n, (names, q) in sent.value.items():
                    same = np.array([k for k, v in enumerate(vecs) if len(v) == n], int)
                    step = max(1, CELLS // len(names))
                    for lo in range(0, len(same), step):
                        at = same[lo : lo + step]
                        x = np.array([vecs[k] for k in at], float)
                        dots = x @ q.T
                        r, c = np.nonzero((dots > limit * np.sqrt((x * x).sum(1)[:, None] * (q * q).sum(1)[None, :])) & (ids[at][:, None] != names[None, :]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at][r]), pa.array(names[c]), pa.array(dots[r, c])], names=["i", "j", "v"])

        one = rows.select("i", "e").mapInArrow(run, "i long, j long, v double")
        out = one if out is None else out.unionByName(one)
    return out
