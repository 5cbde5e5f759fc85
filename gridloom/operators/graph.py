"""The matrix as a weighted graph: strength of connection, filtering, smoothing weight and matching."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blas import arwsum, axpby, cut, diag, given_diag, symmetrize, transpose, vec  # noqa: F401

#: Rounds after which the results of rounds are written as one table.
FOLD = 20


def with_diagonals(a: DataFrame) -> DataFrame:
    """Entries with |a_ii| and |a_jj|: (i, j, v, scale = sqrt|a_ii a_jj|)."""
    d = cut(given_diag(a))
    two = a.where("i is not null").join(vec(d.select(F.col("i").alias("j"), F.col("v").alias("dj"))), "j", "left").join(vec(d.select("i", F.col("v").alias("di"))), "i", "left")
    return two.select("i", "j", "v", F.sqrt(F.abs(F.coalesce("di", F.lit(0.0)) * F.coalesce("dj", F.lit(0.0)))).alias("scale"))


def strong1(a: DataFrame, theta: float) -> DataFrame:
    """|a_ij| > theta sqrt|a_ii a_jj|."""
    return with_diagonals(a).where(F.abs("v") > F.col("scale") * theta).select("i", "j", "v")


def mu(a: DataFrame, theta: float, p: DataFrame | None = None) -> DataFrame:
    """mu_ij = |a_ij| / sqrt|a_ii a_jj| and whether it is strong (mu >= theta and in the row's block)."""
    if p is None:
        m, inside = with_diagonals(a).where("scale > 0").select("i", "j", (F.abs("v") / F.col("scale")).alias("v")), F.lit(True)
    else:  # diagonals and blocks in the same joins
        d = cut(diag(a).join(p, "i", "left").select("i", "v", "blk"))
        two = a.join(vec(d.select(F.col("i").alias("j"), F.col("v").alias("dj"), F.col("blk").alias("bj"))), "j", "left").join(vec(d.select("i", F.col("v").alias("di"), F.col("blk").alias("bi"))), "i")
        scale = F.sqrt(F.abs(F.col("di") * F.coalesce("dj", F.lit(0.0))))
        m = two.where("bi is not null").select("i", "j", F.abs("v").alias("v"), scale.alias("scale"), "bi", "bj").where("scale > 0").withColumn("v", F.col("v") / F.col("scale"))
        inside = F.coalesce(F.col("bi") == F.col("bj"), F.lit(False))
    return m.select("i", "j", "v", ((F.col("v") >= theta) & inside).alias("strong"))


def filtered(a: DataFrame, theta: float) -> DataFrame:
    """Off-diagonal entries below theta sqrt|a_ii a_jj| are dropped and their sum is taken off the diagonal."""
    s = with_diagonals(a)
    weak = (F.col("i") != F.col("j")) & (F.abs("v") < F.col("scale") * theta)
    # A weak entry goes to the diagonal, so one sum makes all; every row has a diagonal.
    e = s.select("i", F.when(weak, F.col("i")).otherwise(F.col("j")).alias("j"), F.when(weak, -F.col("v")).otherwise(F.col("v")).alias("v"))
    on = a.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("v"))
    return e.unionByName(on).groupBy("i", "j").agg(F.sum("v").alias("v"))


def omega(a: DataFrame) -> DataFrame:
    """One row: 4 / (3 max |row sum of absolute values / diagonal|)."""
    r = arwsum(a).withColumnRenamed("v", "s").join(diag(a), "i")
    one = F.when(F.col("v") == 0, 1.0).otherwise(1.0 / F.col("v"))
    return r.agg((4.0 / (3.0 * F.max(F.abs(one * F.col("s"))))).alias("omega"))


def smoother_matrix(a: DataFrame, w: float, af: DataFrame | None = None) -> DataFrame:
    """S = I - w D^-1 A_F."""
    af = a if af is None else af
    d = diag(af).select("i", F.when(F.col("v") == 0, 1.0).otherwise(1.0 / F.col("v")).alias("d"))
    on = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return af.join(d, "i").select("i", "j", (on - F.col("d") * F.col("v") * float(w)).alias("v"))


def degrees(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.count("*").alias("degree"))


def degree_order(a: DataFrame, p: DataFrame) -> DataFrame:
    """Rank of each node by falling degree, then by number, in its block."""
    from pyspark.sql import Window

    w = Window.partitionBy("blk").orderBy(F.desc("degree"), "i")
    return degrees(a).join(p, "i").select("i", "blk", "degree", F.row_number().over(w).alias("rank"))


def edge_weights(a: DataFrame, w: DataFrame | None = None, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Matching weights of i < j: log of 1 - 2 a_ij w_i w_j / (a_ii w_i^2 + a_jj w_j^2) over 0.999 of the least."""
    d = diag(a).withColumnRenamed("v", "d")
    d = d.withColumn("w", F.lit(1.0)) if w is None else d.join(w.select("i", F.col("v").alias("w")), "i", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    left = d.select("i", F.col("d").alias("di"), F.col("w").alias("wi"))
    right = d.select(F.col("i").alias("j"), F.col("d").alias("dj"), F.col("w").alias("wj"))
    up = a.where("i < j").join(left, "i").join(right, "j")
    den = F.col("di") * F.col("wi") * F.col("wi") + F.col("dj") * F.col("wj") * F.col("wj")
    e = up.select("i", "j", F.when(den <= eps, F.lit(eps)).otherwise(1.0 - 2.0 * F.col("v") * F.col("wi") * F.col("wj") / den).alias("c"))
    least = e.where("c <> 0").agg(F.min(F.abs("c")).alias("m"))
    return e.where("c <> 0").crossJoin(F.broadcast(least)).select("i", "j", F.log(F.abs("c") / (0.999 * F.col("m"))).alias("v"))  # one row


def mutual_round(both: DataFrame) -> DataFrame:
    """Pairs (i < j) that choose each other: the heaviest edge, of equal ones the larger neighbour."""
    best = both.groupBy("i").agg(F.max_by("j", F.struct("v", "j")).alias("mate"))
    return best.where("i < mate").join(vec(best.select(F.col("i").alias("mate"), F.col("mate").alias("back"))), "mate").where("back = i").select("i", F.col("mate").alias("j"))


def matching(weights: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Half-approximate maximum weight matching by locally dominant edges: rounds until no edge is left.

    Each round takes an edge of the largest weight, so the rounds end; with ``max_rounds`` it is an error if edges are
    left after them.
    """
    both = cut(weights.select("i", "j", "v").union(transpose(weights).select("i", "j", "v")).where("i <> j"))
    pairs = None
    for done in itertools.count():
        if not both.limit(1).count():
            break
        if done == max_rounds:
            raise RuntimeError(f"matching: edges are left after {max_rounds} rounds")
        new = cut(mutual_round(both))
        pairs = new if pairs is None else pairs.union(new)
        if done % FOLD == FOLD - 1:
            pairs = cut(pairs)
        used = new.select("i").union(new.select("j"))
        both = cut(both.join(used, "i", "left_anti").join(used.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j", "v"))
    return cut(pairs) if pairs is not None else weights.select("i", "j").limit(0)


def matching_statistics(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: nodes, pairs, nodes without a partner, and of these the singletons, which have no neighbour at all."""
    n = nodes.groupBy("i").agg(F.max(F.col("i") != F.col("j")).alias("linked")).agg(F.count("*").alias("nodes"), F.count(F.when(~F.col("linked"), 1)).alias("singletons"))
    return n.crossJoin(pairs.agg(F.count("*").alias("pairs"))).withColumn("unmatched", F.col("nodes") - 2 * F.col("pairs"))  # one row each
