"""Complex systems: values are struct<re, im>.

A complex system is solved in its equivalent real form: node i becomes the nodes 2 i (real part) and 2 i + 1 (imaginary part)
and an entry the 2 x 2 block [[re, -im], [im, re]].  Both parts of a node stay in one block, so every smoother, hierarchy
and Krylov method works on it; transposing the real form is the conjugate transpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def real_matrix(a: DataFrame) -> DataFrame:
    """(i, j, v) with v struct<re, im> as a real matrix of twice the size; zero parts have no entries."""
    i, j, re, im = F.col("i") * 2, F.col("j") * 2, F.col("v.re"), F.col("v.im")
    four = F.array(*[F.struct(r.alias("i"), c.alias("j"), x.alias("v")) for r, c, x in ((i, j, re), (i, j + 1, -im), (i + 1, j, im), (i + 1, j + 1, re))])
    return a.select(F.explode(four).alias("e")).select("e.i", "e.j", "e.v").where("v <> 0")


def real_vector(x: DataFrame) -> DataFrame:
    two = F.array(F.struct((F.col("i") * 2).alias("i"), F.col("v.re").alias("v")), F.struct((F.col("i") * 2 + 1).alias("i"), F.col("v.im").alias("v")))
    return x.select(F.explode(two).alias("e")).select("e.i", "e.v")


def real_partition(p: DataFrame) -> DataFrame:
    return p.select(F.explode(F.array(F.col("i") * 2, F.col("i") * 2 + 1)).alias("i"), "blk")


def complex_vector(x: DataFrame) -> DataFrame:
    """Back from the real form: (i, v) with v struct<re, im>; a missing part is zero."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("i") % 2 == k, F.col("v"))), F.lit(0.0))
    return x.groupBy(F.expr("i div 2").alias("node")).agg(part(0).alias("re"), part(1).alias("im")).select(F.col("node").alias("i"), F.struct("re", "im").alias("v"))


def hermitian(a: DataFrame) -> DataFrame:
    """The conjugate transpose."""
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.struct(F.col("v.re").alias("re"), (-F.col("v.im")).alias("im")).alias("v"))


def solve_complex(a: DataFrame, b: DataFrame, prec, p: DataFrame | None = None, method: str = "BICGSTAB", **options):
    """Krylov solution of a complex system; ``prec`` is a Preconditioner that is not built yet, or None.

    The result is that of ``solve`` with x as (i, v), v struct<re, im>.
    """
    from gridloom.operators.blas import cut
    from gridloom.scratch import cut_by
    from gridloom.plans.preconditioner import solve

    m, rhs = cut_by(real_matrix(a), "j"), cut(real_vector(b))
    built = prec.build(m, real_partition(p) if p is not None else None) if prec is not None else None
    got = solve(m, rhs, built, method, **options)
    got.x = complex_vector(got.x)
    return got
