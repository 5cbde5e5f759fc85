"""Re-use of a hierarchy while matrix values change: every micro-batch of entries (i, j, v) replaces values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import blas
from gridloom.plans.preconditioner import Preconditioner


def replace_entries(a: DataFrame, update: DataFrame) -> DataFrame:
    """``a`` with the entries of ``update`` in place of its own; the last of equal ones is not defined, sums are not taken."""
    new = update.groupBy("i", "j").agg(F.max("v").alias("v"))
    return a.join(new, ["i", "j"], "left_anti").select("i", "j", "v").unionByName(new)


def rebuild_on(stream: DataFrame, prec: Preconditioner, then: Callable[[Preconditioner, int], None] | None = None):
    """A stream writer whose batches update the finest matrix and, by what they change, the coarse ones below it."""

    def batch(df: DataFrame, number: int) -> None:
        if df.limit(1).count():
            prec.hierarchy_update(blas.cut(df.select("i", "j", "v"))).smoothers_build()
        if then:
            then(prec, number)

    return stream.writeStream.foreachBatch(batch)
