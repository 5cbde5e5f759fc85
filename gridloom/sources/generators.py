"""Finite-difference matrices and right-hand sides generated in parallel from ``range``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.coefficients import SETS_2D, SETS_3D, boundary


def _stencil(dim: int, idim: int, a: str, b: tuple[str, ...], c: str) -> list[str]:
    """One struct(j offset index, v, inside, boundary value) for each neighbour and the diagonal."""
    h = f"{1.0 / (idim + 2)!r}D"
    axes = "xyz"[:dim]
    stride = {k: idim ** (dim - 1 - n) for n, k in enumerate(axes)}
    out = []
    for n, k in enumerate(axes):
        for sign, at, edge in ((-1, f"i{k} = 1", "0D"), (1, f"i{k} = {idim}", "1D")):
            v = f"(-{a}/({h}*{h}) {'-' if sign < 0 else '+'} {b[n]}/(2D*{h}))"
            g = boundary(edge if k == "x" else "x")
            out.append(f"struct(i + {sign * stride[k]} AS j, {v} AS v, NOT ({at}) AS inside, {g} AS g)")
    out.append(f"struct(i AS j, 2D*({'+'.join([a] * dim)})/({h}*{h}) + {c} AS v, true AS inside, 0D AS g)")
    return out


def poisson(spark: SparkSession, dim: int, idim: int, kind: str = "const", a: str | None = None, b: tuple[str, ...] | None = None, c: str | None = None, f: str = "0D", points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(A, rhs) of the 5-point (dim 2) or 7-point (dim 3) problem on ``idim ** dim`` nodes numbered from 1.

    ``kind`` names a coefficient set; ``a``, ``b``, ``c``, ``f`` are SQL expressions of x, y, z that replace its parts.
    ``points`` may give the nodes (i) with columns of their own, which the expressions may use too.
    """
    s = (SETS_2D if dim == 2 else SETS_3D)[kind]
    a = a or s["a"].replace("EPS", f"{s['eps']!r}D")
    b, c = b or s["b"], c or s["c"]
    axes = "xyz"[:dim]
    h = f"{1.0 / (idim + 2)!r}D"
    index = [f"CAST((i - 1) div {idim ** (dim - 1 - n)} % {idim} + 1 AS BIGINT) AS i{k}" for n, k in enumerate(axes)]
    nodes = spark.range(1, idim**dim + 1).select(F.col("id").alias("i")) if points is None else points
    nodes = nodes.selectExpr("*", *index).selectExpr("*", *[f"(i{k} - 1)*{h} AS {k}" for k in axes])
    rows = nodes.selectExpr("i", f"{f} AS f", f"array({', '.join(_stencil(dim, idim, a, b, c))}) AS s")
    matrix = rows.select("i", F.explode("s").alias("e")).where("e.inside").selectExpr("i", "e.j AS j", "e.v AS v")
    total = F.aggregate("s", F.col("f"), lambda t, e: t + F.when(~e.inside, -e.v * e.g).otherwise(F.lit(0.0)))
    return matrix, rows.select("i", total.alias("v"))


def constant_vector(spark: SparkSession, n: int, value: float, start: int = 1) -> DataFrame:
    """All-``value`` vector: the default right-hand side (1) and guess (0)."""
    return spark.range(start, start + n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v"))


def blocks(n_or_df, count: int, start: int = 1) -> DataFrame:
    """Partition (i, blk) of ``n`` rows to ``count`` contiguous blocks."""
    spark, n = n_or_df
    size = -(-n // max(count, 1))
    return spark.range(start, start + n).select(F.col("id").alias("i"), F.expr(f"CAST((id - {start}) div {max(size, 1)} AS INT)").alias("blk"))
