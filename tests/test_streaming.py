"""Streams end where their batch twins end."""

import shutil
from datetime import datetime

from pyspark.sql import functions as F

from metricwell.streaming import events as E

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_streams_equal_batches(spark, data, tmp_path, same):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{data}/events.parquet", tmp_path / "in")
    batch = spark.read.parquet(f"{data}/events.parquet")
    stream = E.read_events(spark, str(tmp_path / "in"), ", ".join(f"{n} {t}" for n, t in batch.dtypes))
    same(E.run_available(E.fold(stream), "folded", str(tmp_path / "c1")).toPandas(), E.fold(batch).toPandas())
    same(E.run_available(E.daily_counts(stream), "daily", str(tmp_path / "c2")).toPandas(), E.daily_counts(batch).toPandas())


def test_state_goes_on_from_its_checkpoint(spark, data, tmp_path, same):
    """Three parts with a restart between them; a batch writes its changed keys alone; compaction changes nothing."""
    batch = spark.read.parquet(f"{data}/events.parquet")
    schema, keys = ", ".join(f"{n} {t}" for n, t in batch.dtypes), ["user_id", "event_type"]
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    few = batch.where("user_id < 3")
    for part in (batch.where("user_id >= 3 OR event_id % 2 = 0"), few.where("event_id % 4 = 1"), few.where("event_id % 4 = 3")):
        part.write.mode("append").parquet(log)
        state = E.fold(E.read_events(spark, log, schema))
        E.run_updates(state, out, mark)
    shape = ", ".join(f"{n} {t}" for n, t in state.dtypes)
    same(E.current(spark, out, shape, keys).toPandas(), E.fold(batch).toPandas())
    sizes = {r["batch"]: r["n"] for r in spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 3 and sizes[1] <= 15 and sizes[2] <= 15 < sizes[0]
    E.compact(spark, out, str(tmp_path / "small"), shape, keys)
    same(E.current(spark, str(tmp_path / "small"), shape, keys).toPandas(), E.fold(batch).toPandas())


def test_rows_behind_the_watermark_are_counted_as_late(spark, tmp_path):
    schema, log, out, mark = "event_id long, ts timestamp_ntz, event_type string", *(str(tmp_path / x) for x in ("log", "out", "mark"))
    parts = [
        ["2024-01-31 10:00:00", "2024-02-10 00:00:00", None],
        ["2024-01-31 11:00:00", "2024-02-07 23:00:00", "2024-02-08 00:00:00", "2024-02-20 00:00:00"],  # the watermark stands at 02-08
        ["2024-02-09 00:00:00", "2024-02-18 12:00:00"],
    ]
    for n, part in enumerate(parts):
        rows = [(i, datetime.fromisoformat(t) if t else None, "x") for i, t in enumerate(part)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(log)
        counts = E.window_counts(E.read_events(spark, log, schema))
        E.run_updates(counts, out, mark)
    got = {(r.grain, r.start): (r.n, r.late) for r in E.current(spark, out, ", ".join(f"{n} {t}" for n, t in counts.dtypes), ["grain", "start", "event_type"]).collect()}
    assert got[("day", "2024-01-31")] == (1, 1) and got[("month", "2024-01-01")] == (1, 1) and got[("week", "2024-01-29")] == (1, 1)
    assert got[("day", "2024-02-07")] == (0, 1) and got[("day", "2024-02-08")] == (1, 0) and got[("day", "2024-02-09")] == (0, 1)
    assert got[("week", "2024-02-05")] == (3, 1) and got[("month", "2024-02-01")] == (6, 0) and got[("day", "2024-02-18")] == (1, 0)
