"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gridloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings are kept where they are set."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()
