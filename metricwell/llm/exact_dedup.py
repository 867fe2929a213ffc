"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition turns its rows into a run: sorted by digest, one row for each. Then partitions exchange runs in the
rounds of a binomial tree, STEPS levels of it at a time, one by default: the 2 ** STEPS partitions whose numbers differ
in those binary digits only deal the pieces of their runs among themselves by the same digits of the digest. Every
receiver merges the sorted pieces it gets: Spark's sorter, a TimSort for keys of several columns, takes ascending runs as
they lie and merges them. It keeps, of equal digests, the row with the smallest identifier and the number of rows behind
it, which makes a sorted run again. After the last round each digest
is left in one partition; before it, a digest that every partition holds has been a single row of each run, so that a
hot group never meets in one task. At every level digests are equal only if a second hash and the length agree too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, materialize, table

#: The characters that a comparison ignores: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
#: Levels of the binomial tree in one exchange; 2 ** STEPS runs meet in a merge.
STEPS = 1
_KEY = ["digest", "proof", "bytes"]
_ORDER = [*_KEY, "less", "none", "doc_id"]


def _runs(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACE, "")
    return docs.select("doc_id", text.alias("text"), bare.alias("bare")).select(
        "doc_id",
        F.unhex(F.sha2(F.encode("bare", "UTF-8"), 256)).alias("digest"),
        F.xxhash64("bare").alias("proof"),
        F.octet_length("bare").cast("long").alias("bytes"),
        F.char_length("text").cast("long").alias("chars"),
    )


def _same_as_last(column: pa.Array) -> np.ndarray:
    """For each value but the first whether it equals the one before; values are not null."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
        return (raw[1:] == raw[:-1]).all(axis=1)
    values = column.to_numpy(zero_copy_only=False)
    return values[1:] == values[:-1]


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows the first one of each key, with the rows of all; the last key of a batch waits for the next batch."""
    wait: pa.RecordBatch | None = None
    for batch in batches:
        if wait is not None:
            batch = pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
        if len(batch) == 0:
            continue
        same = np.logical_and.reduce([_same_as_last(batch.column(c)) for c in _KEY])
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        count = np.add.reduceat(batch.column("n").to_numpy(), first)
        place = batch.schema.get_field_index("n")
        kept = batch.take(pa.array(first)).set_column(place, batch.schema.field(place), pa.array(count))
        yield kept.slice(0, len(kept) - 1)
        wait = kept.slice(len(kept) - 1)
    if wait is not None:
        yield wait


def merge_runs(runs: DataFrame, partitions: int, steps: int = STEPS) -> DataFrame:
    """One row for each (digest, proof, bytes): less and doc_id of the row that stays, and n, the rows behind it."""
    levels = max(1, (partitions - 1).bit_length())
    size = 1 << levels
    slot = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(size)).cast("int")
    level = runs.select(
        *_KEY,
        (-F.col("chars")).alias("less"),
        F.col("doc_id").isNull().alias("none"),
        "doc_id",
        F.lit(1).cast("long").alias("n"),
        (F.spark_partition_id() % size).alias("at"),
    )
    shape = level.schema
    level = level.sortWithinPartitions(*_ORDER).mapInArrow(_retain, shape)
    for low in range(0, levels, steps):
        here = ((1 << min(steps, levels - low)) - 1) << low
        to = F.col("at").bitwiseAND(F.lit(size - 1 - here)).bitwiseOR(slot.bitwiseAND(F.lit(here)))
        level = level.withColumn("at", to).repartitionById(size, F.col("at")).sortWithinPartitions(*_ORDER).mapInArrow(_retain, shape)
    return level.drop("none", "at")


def exact_dedup(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Groups of rows whose texts are equal without white space: one row out for each row in.

    Null text counts as empty, and empty texts are copies of each other. Of a group the row with the most code points
    stays, then the one with the smallest doc_id; a null doc_id comes last. Rows repeated with the same doc_id and
    length share their fate. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    runs = materialize(_runs(docs))
    best = materialize(
        merge_runs(runs, int(spark.conf.get("spark.sql.shuffle.partitions")), steps).select(
            *_KEY,
            "less",
            F.col("doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
        )
    )
    return join_keyed(runs, best, _KEY, "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == -F.col("less"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
