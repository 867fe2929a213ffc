"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker looks at in one go, if not said otherwise; bounds its memory whatever a batch holds.
CHUNK_CHARS = 1_000_000
#: A key is hot if it holds more than a HEAVY-th of all rows; there are fewer than HEAVY such keys in any data.
HEAVY = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one where none is set and Spark runs in one process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='metricwell-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/metricwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_keyed(many: DataFrame, one: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key and, in the column rows, how many rows of many it meets.

    Hot keys, fewer than HEAVY by their definition, are joined by broadcast, so that their rows stay where they are;
    the others are shuffled, and none of them is more than a HEAVY-th of many. how: inner or left_semi; both sides are
    read more than once and should be written tables. Null keys match nothing, and hold no rows of one.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0
    heavy = F.col(rows) * HEAVY > F.lit(total)
    hot, cold = one.where(heavy), one.where(~heavy)
    light = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return many.join(F.broadcast(hot), keys, how).unionByName(light)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small in a Python worker.

    Spark reads the setting when a query starts, so it stays in the session; a lower one of the caller's is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def held_out(doc_id: Column) -> Column:
    """True for the evaluation fold: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches holding about as many characters each as chars says, with their texts (null as empty)."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        start, size = 0, 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= chars:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]
