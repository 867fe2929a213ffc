"""Hand-computed cases of single operators."""

import pytest
from pyspark.sql import functions as F

from metricwell.operators import drivers as D
from metricwell.operators import kpi as K
from metricwell.operators import series as Z
from metricwell.operators import text as X
from metricwell.operators.canonical import delivery_fields, require_unique
from metricwell.sources.tables import read_csv, read_table, write_parquet


def test_weeks_end_on_monday(spark):
    rows = spark.sql("SELECT * FROM VALUES (DATE '2024-01-01'), (DATE '2024-01-02'), (DATE '2024-01-08') t(d)")
    got = [r[0] for r in rows.select(K.bucket(F.col("d"), "week")).collect()]
    assert got == ["2023-12-26/2024-01-01", "2024-01-02/2024-01-08", "2024-01-02/2024-01-08"]


def test_absent_category_is_a_price_effect(spark):
    rows = spark.createDataFrame([("a", 2, 20.0, 3, 36.0), ("new", 0, 0.0, 1, 5.0)], "k string, q0 long, r0 double, q1 long, r1 double")
    r = D.pvm(rows).first()
    assert (r.total_change, r.volume_effect, r.price_effect) == (21.0, 20.0, 11.0)
    assert abs(r.total_change - r.volume_effect - r.price_effect - r.mix_effect) < 0.01


def test_history_skips_nulls(spark):
    values = [10.0, None, 20.0, 30.0, None, 40.0]
    rows = spark.createDataFrame([("s", f"2024-{i + 1:02d}", v, 1) for i, v in enumerate(values)], "series_id string, period string, value double, sample_size long")
    last = Z.baselines(rows).where("period = '2024-06'").first()
    assert last.rolling_mean == 20.0 and last.rolling_std == 10.0 and last.previous_period == 30.0 and last.ewma == 0.5 * 30 + 0.5 * 15
    assert last.method == "rolling_mean"


def test_no_spread_no_z(spark):
    rows = spark.createDataFrame([("s", f"2024-{i + 1:02d}", 5.0, 1) for i in range(5)], "series_id string, period string, value double, sample_size long")
    last = Z.signals(Z.baselines(rows)).where("period = '2024-05'").first()
    assert last.z is None and last.robust_z is None and last.percentile == 100.0


def test_delivery_flag_precedence(spark):
    rows = spark.sql("""SELECT CAST(a AS timestamp) purchase_timestamp, CAST(b AS timestamp) carrier_delivery_timestamp, CAST(c AS timestamp) customer_delivery_timestamp, CAST(a AS timestamp) estimated_delivery_timestamp
        FROM VALUES ('2024-01-05', '2024-01-04', NULL), ('2024-01-05', '2024-01-06', NULL), ('2024-01-05', NULL, '2024-01-07'), ('2024-01-05', '2024-01-06', '2024-01-07') t(a, b, c)""")
    assert [r.delivery_data_quality_flag for r in delivery_fields(rows).collect()] == ["INVALID_SEQUENCE", "MISSING_CUSTOMER_DATE", "MISSING_CARRIER_DATE", "VALID"]


def test_duplicate_key_fails(spark):
    with pytest.raises(Exception, match="duplicate key"):
        require_unique(spark.createDataFrame([(1,), (1,)], "k long"), "k").collect()


def test_rejections(spark, data):
    with pytest.raises(ValueError):
        K.check_dimensions("orders", ["product_category"])
    with pytest.raises(PermissionError):
        K.check_dimensions("revenue", ["seller_state"], "PUBLIC_ANALYTICAL")
    with pytest.raises(ValueError):
        K.in_range("ts", "2024-01-01", None)
    with pytest.raises(ValueError):
        read_table(spark, data, "nothing")


def test_csv_and_parquet_round_trip(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("﻿id,ts\n1,2024-01-05 10:00:00\n2,2024-02-06 11:00:00\n".encode())
    rows = read_csv(spark, str(path), spark.createDataFrame([], "id long, ts timestamp").schema)
    write_parquet(rows, str(tmp_path / "out"), "ts")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.id, r.month) for r in back.collect()} == {(1, "2024-01"), (2, "2024-02")}


def test_rank_fusion(spark):
    one = spark.createDataFrame([(1, 7, 1)], "query_id long, doc long, rank int")
    assert X.fuse(one, one.limit(0), key="doc", k=3).first().score == round(1 / 61, 9)
