"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes every stage to the shared scratch folder and reads it back as the next one's input.

Edge cases, in all stages: rows without a doc_id and rows that share one are documents of their own; null and empty
texts are clean, have no near copies and stay, and end as a piece without words; an empty table gives an empty
result; further columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import cut, table
from gridloom.llm.decontaminate import drop_contaminated
from gridloom.llm.near import keep_one
from gridloom.llm.packing import pack
from gridloom.llm.pii import mask_pii
from gridloom.llm.queries import BATCH_ROWS
from gridloom.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; without labels of both kinds none does."""
    spark.conf.set(BATCH_ROWS, "1000")
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least doc_id (rows without one last), then the least hash."""
    spark.conf.set(BATCH_ROWS, "1000")
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; items without words have no window."""
    spark.conf.set(BATCH_ROWS, "1000")
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text, and ``n_chars`` follows; every row stays."""
    return mask_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that they are packed in (``pack_texts`` gives their texts); rows without words in bin -1."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The toxicity model and the bootstrapped patterns cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
