"""Structured Streaming over an append-only event log: keyed state by changed keys, and event-time windows with late rows.

Both run in update mode: a batch gives out the keys that it changed and no others, and the sink writes them under the
number of the batch. A batch that is run again after a failure replaces its own rows, so that the sink is idempotent;
the current state is the last row of each key. Offsets, watermark and state live in the checkpoint, from which a stream
goes on after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRAINS = ("day", "week", "month")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(day, event_type, n): tumbling days; rows later than lateness are dropped past the watermark."""
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _subtotals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and latest times of an Arrow batch, so that a window and type with most of the rows is few rows for its task."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["grain", "start", "ends", "event_type"]).aggregate([([], "count_all"), ("ts", "max")])
        yield from rows.rename_columns(["grain", "start", "ends", "event_type", "n", "ts"]).combine_chunks().to_batches()


def _count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, late = state.get if state.exists else (0, 0)
    closed = key[2] <= state.getCurrentWatermarkMs()
    for part in parts:
        rows = int(part["n"].sum())
        n, late = (n, late + rows) if closed else (n + rows, late)
    state.update((n, late))
    yield pd.DataFrame({"grain": [key[0]], "start": [key[1]], "event_type": [key[3]], "n": [n], "late": [late]})


def window_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(grain, start, event_type, n, late) of tumbling days, weeks from Monday and months, all in one stream, in update mode.

    A row is late, and counted as such, where its window ended at or before the watermark: the largest event time of all
    batches before, less lateness. A late day may still be in time for its week or month. Null event times are in no window.
    """
    seen = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    spans = [F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "ts").alias("s"), (F.date_trunc(g, "ts") + F.expr(f"INTERVAL 1 {g}")).alias("e")) for g in GRAINS]
    each = seen.select("event_type", "ts", F.explode(F.array(*spans)).alias("w"))
    each = each.select("w.grain", F.date_format("w.s", "yyyy-MM-dd").alias("start"), F.unix_millis("w.e").alias("ends"), "event_type", "ts")
    parts = each.mapInArrow(_subtotals, "grain string, start string, ends long, event_type string, n long, ts timestamp").withWatermark("ts", lateness)
    return parts.groupBy("grain", "start", "ends", "event_type").applyInPandasWithState(
        _count, "grain string, start string, event_type string, n long, late long", "n long, late long", "update", GroupStateTimeout.NoTimeout
    )


def fold(events: DataFrame) -> DataFrame:
    """Current state of each (user_id, event_type): first and last event, last value that is not null."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id", "event_type").agg(F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"), F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("value"), F.count("*").alias("events"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything there is now, through the stream, as a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, through the stream in update mode: each batch's changed keys, as Parquet under its number."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row of each key that run_updates has written to path. schema: the stream's columns."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*keys, "last.*")


def compact(spark: SparkSession, path: str, to: str, schema: str, keys: list[str]) -> None:
    """The current state at path as the first batch of the empty folder to, from where current reads it alike."""
    current(spark, path, schema, keys).write.parquet(f"{to}/batch=-1")
