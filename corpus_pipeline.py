"""A corpus pipeline over the table documents: five stages, each one of the operators of metricwell.llm.

Every stage works on all rows that the one before it kept. ORACLE_SQL is None: language identification and signatures
have no SQL. Tests hold the first three stages against brute force, mixing against the SQL of op5 and packing against the
tokenizer, each on the rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwell.llm.bagminhash import near_duplicates
from metricwell.llm.common import materialize, scratch, table
from metricwell.llm.language_id import keep_identified
from metricwell.llm.line_chunks import without_repeats
from metricwell.llm.mixing import mix
from metricwell.llm.packing import pack

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: null texts, texts without a letter, and those that no language fits."""
    return keep_identified(docs.select(*_COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated runs of two or more lines from the texts; documents of which nothing is left go."""
    changed = F.col("removed_lines") > 0
    out = without_repeats(docs).where(~changed | (F.trim("text") != ""))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    return out.select("doc.doc_id", "text", "doc.lang", "doc.source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the one with the smallest doc_id."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the weights of domain, language and source, some of them in two epochs.

    Documents stay whole: the one in which a leaf's prefix ends is taken as it is.
    """
    return mix(docs).select(*[f"doc.{c}" for c in _COLUMNS])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet into the shared folder and read again."""
    scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
