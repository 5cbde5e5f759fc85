"""Scratch tables in the folder that all machines share: written steps cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_written: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset on a single machine (tests) one is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back; what was written here already is not written again."""
    if df in _written:
        return df
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return _known(spark.read.schema(df.schema).parquet(path))


def _known(df: DataFrame) -> DataFrame:
    _written.add(df)
    return df


@atexit.register
def drop_scratch() -> None:
    """Removes what was written; called at exit, or before that by a long session that needs none of it any more."""
    _written.clear()
    while _made:
        spark, path = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder is scratch space
            return


def cut_by(df: DataFrame, key: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Like ``cut``, as a table in ``buckets`` buckets of ``key``: joins and groups by the key do not shuffle it again.

    ``dealt``: ``df`` is partitioned by the key already; otherwise there would be more files, with the same rows.
    """
    spark = df.sparkSession
    name = f"gridloom_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    _made.append((spark, path))
    return _known(spark.table(name))
