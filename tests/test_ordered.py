"""Nearest values, the automaton and the contract rules against plain loops, over more parts than one."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwell.operators import contracts as C
from metricwell.operators import decisions as L
from metricwell.operators import ordered as O
from metricwell.operators import profile as P
from metricwell.plans import checks


def test_numbers_match_as_if_compared_with_all(spark):
    draw = random.Random(3)
    known = [(u, round(draw.choice((draw.uniform(-30, 30), draw.uniform(-1e6, 1e6))), draw.choice((0, 3)))) for u in ("a", "b") for _ in range(150)] + [("c", None), (None, 5.0)]
    points = []
    for i in range(600):
        u, v = draw.choice(known[:300])
        points.append((i, u, v + draw.choice((0, 0.004, -0.0101, v * 0.0004, -abs(v) * 0.00051, 17.0))))
    points += [(600, "c", 1.0), (601, None, 5.0), (602, "a", None), *((700 + i, "a", 3.0) for i in range(400))]
    got = O.match_values(spark.createDataFrame(points, "id long, unit string, value double"), spark.createDataFrame(known, "unit string, known double")).collect()
    assert len(got) == len(points)
    for r in got:
        near = [v for u, v in known if u == r.unit and None not in (u, v, r.value)]
        assert r.matched == any(abs(r.value - v) <= max(0.0005 * abs(v), 0.01) for v in near)
        assert r.nearest == min(near, key=lambda v: (abs(r.value - v), v), default=None) if r.value is not None and r.unit is not None else r.nearest is None


@pytest.mark.parametrize("parts", [1, 7])
def test_automaton_over_parts(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice([1, 1, 1, 2, 3, None]), draw.randint(0, 50), i, draw.choice(["SUBMIT", "REVIEWED", "APPROVED", "REJECTED", "odd"])) for i in range(800)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.before, r.legal, r.after) for r in O.run_automaton(spark.createDataFrame(rows, "k long, at long, id long, x string"), "k", ["at", "id"], "x", checks.MOVES, "NONE").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for k, _, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        before = state.get(k, "NONE")
        after = checks.MOVES.get((before, x))
        assert got[i] == (before, after is not None, after or before)
        state[k] = after or before


def test_budgets_run_over_parts(spark):
    draw, rows = random.Random(8), []
    for i in range(500):
        rows.append((draw.choice(["x", "x", "x", "y"]), draw.randint(0, 9), i, 1.0, float(draw.randint(0, 3))))
    got = {(r.investigation, r.budget): (r.used, r.id) for r in L.budget_breaches(spark.createDataFrame(rows, "investigation string, at long, id long, calls double, tokens double"), {"calls": 50.0, "tokens": 700.0}).collect()}
    want, used = {}, Counter()
    for n, _, i, a, b in sorted(rows, key=lambda r: (r[1], r[2])):
        for budget, limit, spent in (("calls", 50, a), ("tokens", 700, b)):
            if spent > 0 and used[n, budget] >= limit:
                want.setdefault((n, budget), (used[n, budget], i))
            used[n, budget] += spent
    assert got == want and want


def test_budgets_of_odd_rows_like_sql(spark, duck, same, tmp_path):
    at = lambda n: f"2024-01-01 00:00:{n:02d}"
    rows = [
        (1, at(1), 1, 1499.99996), (2, at(2), 1, 5.0), (3, at(3), 1, 7.0),  # just under the limit, shown as the limit
        (4, None, 2, 2000.0), (5, at(1), 2, 5.0), (6, at(2), 2, 6.0),  # no time: last
        (7, at(1), None, 2000.0), (8, at(2), None, 5.0),  # no user
        (9, at(1), 3, 1500.0), (9, at(1), 3, 10.0),  # alike in time and id
    ]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double")
    events = events.selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "user_id", "'error' AS event_type", "value", "'' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    sql = checks.query.sql["l28_budget_breach"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(sql).df()
    same(checks.query.queries["l28_budget_breach"](spark, str(tmp_path)).toPandas(), want)
    assert sorted(want.id) == [3, 8, 9]


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_over_parts(spark, parts, capsys):
    draw = random.Random(parts)
    values = {"hot": [draw.choice((1.0, 1.0, 1.0, 2.0, 3.0)) for _ in range(701)], "many": [round(draw.uniform(-9, 9), 4) for _ in range(1000)], "two": [1.0, 2.0], "one": [5.0], "none": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, v double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: (r.a, r.b, r.c) for r in O.quantiles(rows, "g", "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
        wide = spark.range(3000).selectExpr("id % 7 AS few", "CAST(id * 7 % 3000 AS decimal(18,4)) / 8 AS many", "CAST(NULL AS double) AS none")
        found = P.described(wide, ["few", "many", "none"])
        table = {r["column"]: r for r in found.collect()}
        found.explain()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(values) - {"none"}
    for g, found_at in got.items():
        assert found_at == pytest.approx(tuple(np.quantile(values[g], (0.25, 0.5, 1.0))), abs=1e-9)
    assert (table["many"].p25, table["many"].p50, table["many"].p75) == tuple(np.quantile(np.arange(3000) / 8, (0.25, 0.5, 0.75)).round(6))
    assert (table["few"].p25, table["few"].p75, table["none"]["count"], table["none"].p50) == (1.0, 5.0, 0, None)
    assert "percentile" not in capsys.readouterr().out  # which holds all distinct values in one task


def test_every_rule_is_broken_once(spark):
    dim, flag = {"name": "state", "source_table": "dim_customer", "supported": True, "unsupported_reason": None}, {"source_column": C.DELIVERY_FLAG, "applied_by_default": True}
    variants = [{"variant_id": v, "is_default": i == 0} for i, v in enumerate(C.REVIEW_VARIANTS)]
    good = {"kpi": "aov", "aggregation": "SUM", "has_ratio": False, "base_grain": "order", "source_tables": ["fact_orders"], "source_columns": ["agg_order_items.item_price_total"], "dimensions": [dim], "filters": [flag], "variants": variants, "drivers": [{"driver_name": "price", "is_causal_claim": False}], "materiality_implemented": False, "review_governance_reference": "doc"}
    faults = {
        "unknown_table": {"source_tables": ["fact_orders", "weather"]}, "unknown_dimension_table": {"dimensions": [dim | {"source_table": "weather"}]}, "no_unsupported_reason": {"dimensions": [dim | {"supported": False}]},
        "ratio_missing": {"aggregation": "RATIO"}, "not_one_default": {"variants": [v | {"is_default": True} for v in variants]}, "revenue_source": {"kpi": "revenue", "source_columns": ["x"]}, "revenue_from_payments": {"kpi": "revenue", "source_columns": ["order_items.price", "fact_payments.payment_value"]},
        "repeat_customer": {"kpi": "repeat_purchase_rate", "base_grain": "customer_unique_id"}, "repeat_grain": {"kpi": "repeat_purchase_rate", "source_columns": ["customer_unique_id"]}, "delivery_filter": {"kpi": "avg_delivery_days", "filters": [flag | {"applied_by_default": False}]},
        "review_reference": {"kpi": "avg_review_score", "review_governance_reference": None}, "review_variants": {"kpi": "avg_review_score", "variants": variants[:1]}, "causal_driver": {"drivers": [{"driver_name": "price", "is_causal_claim": True}]}, "materiality": {"materiality_implemented": True},
    }
    rows = [{"contract_id": i, **good, **change} for i, change in enumerate(faults.values())] + [{"contract_id": 90, **good}, {"contract_id": 91, **good}, {"contract_id": 91, **good}]
    rows.append({"contract_id": 92, **good, "source_tables": None, "dimensions": None, "filters": None, "variants": None, "drivers": None})
    schema = (
        "contract_id long, kpi string, aggregation string, has_ratio boolean, base_grain string, source_tables array<string>, source_columns array<string>, "
        "dimensions array<struct<name: string, source_table: string, supported: boolean, unsupported_reason: string>>, filters array<struct<source_column: string, applied_by_default: boolean>>, "
        "variants array<struct<variant_id: string, is_default: boolean>>, drivers array<struct<driver_name: string, is_causal_claim: boolean>>, materiality_implemented boolean, review_governance_reference string"
    )
    got = {(r.contract_id, r.rule) for r in C.contract_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(i, rule) for i, rule in enumerate(faults)} | {(91, "duplicate_contract")}


def test_digest_does_not_depend_on_order(spark):
    from metricwell.operators.graph import content_digest

    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("v"))
    one, two = (content_digest(r, ["id", "v"], leaf).first() for r, leaf in ((rows, 20), (rows.orderBy(F.desc("id")).repartition(9), 20)))
    assert one == two and one["items"] == 3000
    others = [rows.where("id > 0"), rows.union(rows.where("id = 0")), rows.withColumn("v", F.when(F.col("id") != 8, F.col("v")))]
    assert len({content_digest(r, ["id", "v"], 20).first()["digest"] for r in [rows, *others]}) == 4 and content_digest(rows.limit(0), ["id"]).first()["items"] == 0
