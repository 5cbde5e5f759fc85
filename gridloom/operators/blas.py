"""Sparse BLAS on DataFrames: matrices (i, j, v), vectors (i, v); a missing index is zero.

Everything is built-in expressions: products are equi-joins with hash aggregation, so partial sums combine before
the shuffle; transposes are renamings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.scratch import cut  # noqa: F401


def assemble(entries: DataFrame) -> DataFrame:
    """Sums duplicate entries."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def clean_zeros(a: DataFrame) -> DataFrame:
    return a.where("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(x: DataFrame, alpha: float) -> DataFrame:
    return x.withColumn("v", F.col("v") * float(alpha))


def diag(a: DataFrame) -> DataFrame:
    """Diagonal of every row that has entries; a row without one has 0."""
    return a.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).alias("v"))


def given_diag(a: DataFrame) -> DataFrame:
    """Diagonal of the rows that have one: no other entry moves."""
    return a.where("i = j").groupBy("i").agg(F.sum("v").alias("v"))


def reciprocal(d: Column) -> Column:
    """1 / d, and 1 where d is 0."""
    return F.when(d == 0, 1.0).otherwise(1.0 / d)


def inv_diag(a: DataFrame) -> DataFrame:
    return diag(a).withColumn("v", reciprocal(F.col("v")))


def arwsum(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum(F.abs("v")).alias("v"))


def l1_diag(a: DataFrame) -> DataFrame:
    """Absolute row sum without the diagonal, plus the diagonal."""
    on = F.col("i") == F.col("j")
    return a.groupBy("i").agg(F.sum(F.when(on, F.col("v")).otherwise(F.abs("v"))).alias("v"))


def row_scale(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d.select("i", F.col("v").alias("d")), "i").select("i", "j", (F.col("v") * F.col("d")).alias("v"))


def tril(a: DataFrame, upto: int = 0) -> DataFrame:
    return a.where(F.col("j") <= F.col("i") + upto)


def triu(a: DataFrame, above: int = 0) -> DataFrame:
    return a.where(F.col("j") > F.col("i") + above)


def vec(x: DataFrame) -> DataFrame:
    """The side of a join that has a row a node: it is hashed, and the entries of the other side are not sorted."""
    return x.hint("shuffle_hash")


def block_of(a: DataFrame, p: DataFrame) -> DataFrame:
    """Entries with the blocks of their row and column: (i, j, v, bi, bj)."""
    by_column = a.join(vec(p.select(F.col("i").alias("j"), F.col("blk").alias("bj"))), "j")
    return by_column.join(vec(p.select("i", F.col("blk").alias("bi"))), "i").select("i", "j", "v", "bi", "bj")


def block_clip(a: DataFrame, p: DataFrame, inside: bool = True) -> DataFrame:
    return block_of(a, p).where("bi = bj" if inside else "bi <> bj").select("i", "j", "v")


def spmv(a: DataFrame, x: DataFrame, alpha: float = 1.0, y: DataFrame | None = None, beta: float = 0.0, trans: str = "N") -> DataFrame:
    """alpha op(A) x + beta y; op is the matrix (N) or its transpose (T, and C for real values)."""
    m = a if trans == "N" else transpose(a)
    ax = m.join(vec(x.select(F.col("i").alias("j"), F.col("v").alias("x"))), "j").groupBy("i").agg((F.sum(F.col("v") * F.col("x")) * float(alpha)).alias("v"))
    return ax if y is None or beta == 0.0 else axpby(1.0, ax, beta, y)


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("c", "j")


def axpby(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    both = x.select("i", (F.col("v") * float(alpha)).alias("v")).unionByName(y.select("i", (F.col("v") * float(beta)).alias("v")))
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    return assemble(scale(a, alpha).select("i", "j", "v").unionByName(scale(b, beta).select("i", "j", "v")))


def mlt(d: DataFrame, x: DataFrame, alpha: float = 1.0, y: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """alpha d * x + beta y, element by element."""
    p = d.select("i", F.col("v").alias("d")).join(x, "i").select("i", (F.col("v") * F.col("d") * float(alpha)).alias("v"))
    return p if y is None or beta == 0.0 else axpby(1.0, p, beta, y)


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def nrm2(x: DataFrame) -> float:
    return x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0


def amax(x: DataFrame) -> float:
    return x.agg(F.max(F.abs("v"))).first()[0] or 0.0


MAX_GATHER = 10_000_000


def gather(x: DataFrame, start: int = 1):
    """A vector of at most ``MAX_GATHER`` rows (checked) as a numpy array on the driver; missing entries are 0."""
    import numpy as np

    n, top = x.agg(F.count("*"), F.max("i")).first()
    if n > MAX_GATHER or (top or 0) - start >= MAX_GATHER:
        raise ValueError(f"a vector of {n} entries up to {top} is too large for the driver")
    t = x.toArrow()
    out = np.zeros((top or start - 1) - start + 1)
    out[t.column("i").to_numpy() - start] = t.column("v").to_numpy()
    return out


def replicate(x: DataFrame, start: int = 1):
    """``gather`` and a copy on every executor (a broadcast)."""
    return x.sparkSession.sparkContext.broadcast(gather(x, start))


def scatter(spark, values, p: DataFrame, start: int = 1) -> DataFrame:
    """A vector on the driver by the blocks of ``p`` (i, blk): (i, v, blk)."""
    import pyarrow as pa

    rows = spark.createDataFrame(pa.table({"i": pa.array(range(start, start + len(values)), pa.int64()), "v": pa.array(values, pa.float64())}))
    return rows.join(p, "i").select("i", "v", "blk")


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    return axpby(1.0, b, -1.0, spmv(a, x))


def bandwidth(a: DataFrame) -> DataFrame:
    """Lower and upper bandwidth and profile (sum over rows of the distance from the first entry to the diagonal)."""
    rows = a.groupBy("i").agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
    return rows.agg(F.max(F.greatest(F.col("i") - F.col("lo"), F.lit(0))).alias("lower"), F.max(F.greatest(F.col("hi") - F.col("i"), F.lit(0))).alias("upper"), F.sum(F.greatest(F.col("i") - F.col("lo"), F.lit(0))).alias("profile"))


def frobenius(a: DataFrame) -> float:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0


def renumber(a: DataFrame, perm: DataFrame) -> DataFrame:
    """Both indices replaced by ``perm`` (old, new)."""
    return a.join(perm.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(perm.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def block_renumbering(p: DataFrame) -> DataFrame:
    """Contiguous ids by (blk, i): (old, new).  Ranks are made inside blocks; offsets come from the block counts."""
    from pyspark.sql import Window

    counts = p.groupBy("blk").count()
    before = counts.select("blk", (F.sum("count").over(Window.orderBy("blk")) - F.col("count")).alias("base"))  # one row a block
    rank = F.row_number().over(Window.partitionBy("blk").orderBy("i"))
    return p.withColumn("r", rank).join(F.broadcast(before), "blk").select(F.col("i").alias("old"), (F.col("r") + F.col("base")).alias("new"))


def symmetrize(a: DataFrame) -> DataFrame:
    return add(a, transpose(a))


def halo(a: DataFrame, p: DataFrame) -> DataFrame:
    """Columns that a block needs from others: (blk, i)."""
    return block_of(a, p).where("bi <> bj").select(F.col("bi").alias("blk"), F.col("j").alias("i")).distinct()


def overlap(a: DataFrame, p: DataFrame, rounds: int) -> DataFrame:
    """(blk, i) of every block after ``rounds`` of taking in neighbours."""
    own = p.select("blk", "i")
    for _ in range(rounds):
        own = own.union(own.join(a.select("i", "j"), "i").select("blk", F.col("j").alias("i"))).distinct()
    return own


def spmv_local(a: DataFrame, p: DataFrame, x: DataFrame, trans: str = "N") -> DataFrame:
    """A x by entries inside the blocks of ``p`` only: what a block knows without its neighbours."""
    m = a if trans == "N" else transpose(a)
    known = p.join(x, "i").select(F.col("i").alias("j"), F.col("blk").alias("bj"), F.col("v").alias("x"))
    y = m.join(vec(known), "j").groupBy("i", "bj").agg(F.sum(F.col("v") * F.col("x")).alias("v"))  # by block of the columns
    return y.join(p, "i").where("blk = bj").select("i", "v")


def halo_rows(a: DataFrame, p: DataFrame) -> DataFrame:
    """(blk, i, j, v): the rows of the matrix that a block needs from others."""
    return halo(a, p).join(a, "i").select("blk", "i", "j", "v")


def overlap_reduce(y: DataFrame, how: str = "SUM") -> DataFrame:
    """(i, v) of copies (blk, i, v): their sum or, with AVG, their mean."""
    return y.groupBy("i").agg((F.avg("v") if how.upper() == "AVG" else F.sum("v")).alias("v"))


def merged_blocks(a: DataFrame, p: DataFrame, target: int) -> DataFrame:
    """(i, blk): blocks are paired by the weight of the entries between them until there are at most ``target``.

    Blocks without a partner are paired in the order of their numbers.  A block is named by its least member.  The graph
    of the blocks has a node a block; its matching runs in rounds.
    """
    from gridloom.operators.graph import matching

    between = cut(block_of(a, p).where("bi <> bj").groupBy(F.least("bi", "bj").alias("i"), F.greatest("bi", "bj").alias("j")).agg(F.sum(F.abs("v")).alias("v")))
    names = cut(p.select("blk").distinct().select("blk", F.col("blk").alias("to")))  # where each first block is now
    n = names.count()
    while n > target:
        now = names.select(F.col("to").alias("i")).distinct()
        step = cut(now.join(matching(between).select(F.col("j").alias("i"), F.col("i").alias("less")), "i", "left").select("i", F.coalesce("less", "i").alias("to")))
        if step.where("i <> to").limit(1).count() == 0:  # no two touch: neighbours in number
            pair = now.withColumn("pair", F.floor((F.row_number().over(Window.orderBy("i")) - 1) / 2))  # one row a block
            step = cut(pair.select("i", F.min("i").over(Window.partitionBy("pair")).alias("to")))
        names = cut(names.join(step.select(F.col("i").alias("to"), F.col("to").alias("next")), "to").select("blk", F.col("next").alias("to")))
        ends = between.join(step.select("i", F.col("to").alias("ti")), "i").join(step.select(F.col("i").alias("j"), F.col("to").alias("tj")), "j").where("ti <> tj")
        between = cut(ends.groupBy(F.least("ti", "tj").alias("i"), F.greatest("ti", "tj").alias("j")).agg(F.sum("v").alias("v")))
        n = names.select("to").distinct().count()
    return p.join(names, "blk").select("i", F.col("to").alias("blk"))


# Complex values: v is struct<re, im>.


def cmul(a: Column, b: Column, conj: bool = False) -> Column:
    s = -1.0 if conj else 1.0
    return F.struct((a.re * b.re - s * a.im * b.im).alias("re"), (a.re * b.im + s * a.im * b.re).alias("im"))


def _csum(c: Column) -> Column:
    return F.struct(F.sum(c.re).alias("re"), F.sum(c.im).alias("im"))


def complex_spmv(a: DataFrame, x: DataFrame, trans: str = "N") -> DataFrame:
    """A x, transpose (T) or conjugate transpose (C)."""
    m = a if trans == "N" else transpose(a)
    return m.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").select("i", cmul(F.col("v"), F.col("x"), trans == "C").alias("p")).groupBy("i").agg(_csum(F.col("p")).alias("v"))


def complex_dot(x: DataFrame, y: DataFrame) -> complex:
    r = x.join(y.select("i", F.col("v").alias("w")), "i").select(cmul(F.col("v"), F.col("w"), True).alias("p")).agg(F.sum("p.re"), F.sum("p.im")).first()
    return complex(r[0] or 0.0, r[1] or 0.0)
