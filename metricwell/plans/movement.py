"""Queries of groups A, B, D, E, F, G and H that the other modules leave: levels, verdicts, overview, driver rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drivers as D
from ..operators import kpi as K
from ..operators import profile as P
from ..operators import series as Z
from .analytics import _NOW, _S, _WAS, _items, _seg_sql, _two_sql, monthly, segments
from .canonical import _GEO, _geo
from .sql import Registry

query = Registry()

# A, B
query("a18_geolocation_profile", f"""WITH g AS ({_GEO}), p AS (SELECT prefix, count(*) AS n, count(DISTINCT city) AS cities, count(DISTINCT lower(trim(city))) AS folded, coalesce(stddev(lat) > 0.1 OR stddev(lng) > 0.1, false) AS wide FROM g GROUP BY 1)
    SELECT sum(n)::BIGINT - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS duplicate_rows, count(*) FILTER (cities > 1) AS multi_city, count(*) FILTER (folded > 1) AS multi_city_folded,
    count(*) FILTER (wide) AS wide_spread, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows FROM p""")(lambda c: P.geolocation_profile(_geo(c)))
_REL = (
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
)
query("b6_relationship_audit", " UNION ALL ".join(f"""SELECT '{a}-{b}' AS relationship, *, CASE WHEN left_max > 1 AND right_max > 1 THEN 'N:M' WHEN left_max > 1 THEN 'N:1' WHEN right_max > 1 THEN '1:N' ELSE '1:1' END AS multiplicity, right_max > 1 AS fanout_risk FROM (
    SELECT coalesce(sum(x.n) FILTER (y.n IS NOT NULL), 0)::BIGINT AS left_matched, coalesce(sum(x.n) FILTER (y.n IS NULL), 0)::BIGINT AS left_unmatched, coalesce(sum(y.n) FILTER (x.n IS NOT NULL), 0)::BIGINT AS right_matched,
    coalesce(sum(y.n) FILTER (x.n IS NULL), 0)::BIGINT AS right_unmatched, max(x.n) AS left_max, max(y.n) AS right_max
    FROM (SELECT {k} AS k, count(*) AS n FROM {a} GROUP BY 1) x FULL JOIN (SELECT {j} AS k, count(*) AS n FROM {b} GROUP BY 1) y USING (k))""" for a, k, b, j in _REL))(lambda c: P.relationships({f"{a}-{b}": (c.raw(a), k, c.raw(b), j) for a, k, b, j in _REL}))

# D, E, F
query("d3_joins_on_demand", "SELECT seller_state, count(*) AS n, sum(price)::DOUBLE AS revenue FROM kpi_items GROUP BY 1")(
    lambda c: _items(c, "seller_state").groupBy("seller_state").agg(F.count("*").alias("n"), F.sum("price").alias("revenue"))
)
query(
    "d4_aligned_periods",
    f"SELECT k AS product_category, q0, r0::DOUBLE AS r0, q1, r1::DOUBLE AS r1 FROM ({_two_sql('product_category')})",
)(lambda c: D.two_periods(_items(c, "product_category"), "product_category", _NOW, _WAS))
query("d9_self_comparison", f"""SELECT customer_state, previous, current, round(current - previous, 4) AS absolute_change, round(100 * (current - previous) / nullif(abs(previous), 0), 6) AS percent_change FROM (
    SELECT customer_state, (sum(price) FILTER (month = '{_WAS}'))::DOUBLE AS previous, (sum(price) FILTER (month = '{_NOW}'))::DOUBLE AS current FROM kpi_items WHERE month IN ('{_WAS}', '{_NOW}') GROUP BY 1)""")(lambda c: K.compare_periods(c, _NOW, _WAS, "customer_state"))
_HYP = "SELECT product_category, substr(month, 1, 4) AS year, min(month) AS first_month, max(month) AS last_month FROM kpi_items GROUP BY ALL"


def registry(c):
    """The registry of known events: one row."""
    return c.spark.sql("SELECT 'spike_1998_11' AS event, '1998-11' AS event_month")


@query("d11_events_in_period", f"SELECT product_category, year, event FROM ({_HYP}), (SELECT 'spike_1998_11' AS event, '1998-11' AS event_month) WHERE event_month BETWEEN first_month AND last_month")
def _band(c):
    periods = _items(c, "product_category").groupBy("product_category", F.substring("month", 1, 4).alias("year")).agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    )
    day = lambda m: F.to_date(F.concat(F.col(m), F.lit("-01")))
    months = periods.withColumn(
        "event_month",
        F.explode(F.transform(F.sequence(day("first_month"), day("last_month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))),
    )
    return months.join(F.broadcast(registry(c)), "event_month").select("product_category", "year", "event")


_MEASURES = {
    "revenue": "sum(p)::DOUBLE", "freight_revenue": "sum(f)::DOUBLE", "quantity_sold": "coalesce(sum(n), 0)::DOUBLE", "orders": "count(*)::DOUBLE", "aov": "sum(p)::DOUBLE / nullif(count(p), 0)",
    "avg_delivery_days": "avg(CASE WHEN delivery_data_quality_flag = 'VALID' THEN delivery_days END)",
    "on_time_delivery_rate": "count(*) FILTER (delivery_data_quality_flag = 'VALID' AND delivery_delay_days <= 0) / nullif(count(*) FILTER (delivery_data_quality_flag = 'VALID'), 0)::DOUBLE", "avg_review_score": "avg(latest_review_score)",
}
_OVER = f"""base AS (SELECT month, o.delivery_data_quality_flag, delivery_days, delivery_delay_days, item_price_total AS p, item_freight_total AS f, item_count AS n, latest_review_score FROM order_dates o LEFT JOIN agg_order_items USING (order_id) LEFT JOIN agg_order_reviews USING (order_id) WHERE month IN ('{_WAS}', '{_NOW}')),
    mv AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS kpi, month, {e} AS v FROM base GROUP BY month" for k, e in _MEASURES.items()) + f""" UNION ALL
    SELECT 'review_volume', month, count(*)::DOUBLE FROM (SELECT strftime(review_creation_date, '%Y-%m') AS month FROM fact_reviews JOIN order_dates USING (order_id)) WHERE month IN ('{_WAS}', '{_NOW}') GROUP BY month),
    ov AS (SELECT kpi, round(max(v) FILTER (month = '{_WAS}'), 4) AS previous, round(max(v) FILTER (month = '{_NOW}'), 4) AS current FROM mv GROUP BY 1),
    overview AS (SELECT *, round(current - previous, 4) AS absolute_change, round(100 * (current - previous) / nullif(abs(previous), 0), 4) AS percent_change FROM ov)"""
query(
    "e14_overview",
    f"WITH {_OVER} SELECT * FROM overview ORDER BY abs(percent_change) DESC, kpi",
)(lambda c: K.overview(c, _NOW, _WAS).orderBy(F.desc(F.abs("percent_change")), "kpi"))
query(
    "e16_lineage",
    f"WITH {_OVER}, con AS (SELECT * "
    f"FROM (VALUES {', '.join(str(x) for x in K.CONTRACTS)}) t(kpi, source_table, grain, unit, classification)) "
    "SELECT kpi, current, source_table || ' -> ' || kpi AS lineage, grain, unit, classification FROM overview JOIN con USING (kpi)",
)(
    lambda c: K.overview(c, _NOW, _WAS).join(F.broadcast(K.contracts(c.spark)), "kpi").select(
        "kpi",
        "current",
        F.concat_ws(" -> ", "source_table", "kpi").alias("lineage"),
        "grain",
        "unit",
        "classification",
    )
)
_ALLOWED = ("delivered", "shipped", "canceled")
query(
    "e17_contract_violations",
    f"SELECT 'status_not_allowed' AS rule, order_status AS value, count(*) AS n FROM order_dates WHERE order_status NOT IN {_ALLOWED} "
    "GROUP BY 2 UNION ALL SELECT 'category_missing', 'NULL', count(*) FROM kpi_items WHERE product_category IS NULL HAVING count(*) > 0",
)(lambda c: K.contract_violations(c, _ALLOWED))
query("f6_order_fact", "SELECT order_id, month, item_price_total::DOUBLE AS revenue, latest_review_score, date_diff('day', customer_delivery_timestamp, estimated_delivery_timestamp) AS estimate_accuracy_days FROM order_dates LEFT JOIN agg_order_items USING (order_id) LEFT JOIN agg_order_reviews USING (order_id)")(
    lambda c: c.order_dates.join(c.agg_order_items.select("order_id", "item_price_total"), "order_id", "left").join(c.agg_order_reviews.select("order_id", "latest_review_score"), "order_id", "left").select(
        "order_id",
        "month",
        F.col("item_price_total").alias("revenue"),
        "latest_review_score",
        F.datediff("estimated_delivery_timestamp", "customer_delivery_timestamp").cast("long").alias("estimate_accuracy_days"),
    )
)

# G
_MIN = 30
_LEVELS = f"""it AS (SELECT product_id, coalesce(product_category, 'none') AS category, month FROM kpi_items WHERE month < '{_NOW}'),
    lv AS (SELECT product_id, 'entity' AS level, 1 AS level_rank, count(DISTINCT month) AS n_periods, count(*) AS observations FROM it GROUP BY 1
    UNION ALL SELECT product_id, 'category', 2, n_periods, observations FROM (SELECT DISTINCT product_id, category FROM it) JOIN (SELECT category, count(DISTINCT month) AS n_periods, count(*) AS observations FROM it GROUP BY 1) USING (category)
    UNION ALL SELECT product_id, 'global', 3, n_periods, observations FROM (SELECT DISTINCT product_id FROM it), (SELECT count(DISTINCT month) AS n_periods, count(*) AS observations FROM it))"""


def levels(c):
    """Histories of every product, its category and everything, by GROUPING SETS over one scan of the items."""
    items = _items(c, "product_category").where(F.col("month") < _NOW).select(
        "product_id",
        F.coalesce("product_category", F.lit("none")).alias("category"),
        "month",
    )
    per = items.groupBy("product_id", "category", "month").agg(F.count("*").alias("n"))
    sets = per.groupingSets(
        [["product_id", "category", "month"], ["category", "month"], ["month"]],
        "product_id",
        "category",
        "month",
    ).agg(F.grouping_id().alias("g"), F.sum("n").alias("n"))
    hist = sets.groupBy("g", "product_id", "category").agg(F.count("*").alias("n_periods"), F.sum("n").alias("observations"))
    own = hist.where("g = 0")
    level = lambda df, name, rank: df.select("product_id", F.lit(name).alias("level"), F.lit(rank).alias("level_rank"), "n_periods", "observations")
    keys = own.select("product_id", "category")
    upper = keys.join(hist.where("g = 4").drop("product_id", "g"), "category")
    return level(own, "entity", 1).unionByName(level(upper, "category", 2)).unionByName(
        level(keys.crossJoin(F.broadcast(hist.where("g = 6").drop("product_id", "category", "g"))), "global", 3)
    )


query("g21_level_histories", f"WITH {_LEVELS} SELECT * FROM lv")(levels)
query("g6_level_selection", f"""WITH {_LEVELS}, f AS (SELECT *, n_periods >= 3 AND observations >= {_MIN} AS fine FROM lv), c AS (SELECT product_id, min(level_rank) FILTER (fine) AS good FROM f GROUP BY 1),
    s AS (SELECT f.*, good IS NULL AS insufficient FROM f JOIN c USING (product_id) WHERE level_rank = coalesce(good, 3))
    SELECT product_id, level, n_periods, observations, CASE WHEN insufficient THEN 'all_levels_insufficient' WHEN level_rank = 2 THEN 'entity_history_insufficient' WHEN level_rank = 3 THEN 'entity, category_history_insufficient' END AS fallback_reason,
    insufficient, CASE WHEN insufficient THEN 'NONE' WHEN level_rank = 1 THEN CASE WHEN n_periods >= 6 THEN 'HIGH' ELSE 'MEDIUM' END WHEN n_periods >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""")(lambda c: Z.select_level(levels(c), _MIN, ["product_id"]))
_H = "OVER (PARTITION BY series_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
_PAST = "OVER (PARTITION BY series_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ABS, _REL_PCT = 50_000.0, 15.0


def _tier(ratio: str, a: float, b: float, c: float) -> str:
    return f"CASE WHEN {ratio} >= {c} THEN 3 WHEN {ratio} >= {b} THEN 2 WHEN {ratio} >= {a} THEN 1 ELSE 0 END"


def _mag(b: str) -> str:
    return _tier(f"greatest(abs(value - {b}) / {_ABS}, abs(100 * (value - {b}) / nullif({b}, 0)) / {_REL_PCT})", 1, 2, 4)


_BASES = ("seasonal", "rolling_mean", "ewma", "previous_period")
_DETECT = f"""ser AS ({_S}), b0 AS (SELECT *, coalesce(list(value) FILTER (value IS NOT NULL) {_PAST}, []) AS past, CASE WHEN count(value) OVER y >= 2 THEN avg(value) OVER y END AS seasonal
    FROM ser WINDOW y AS (PARTITION BY series_id, substr(period, 6, 2) ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b01 AS (SELECT *, list_slice(past, greatest(len(past) - 5, 1), len(past)) AS h FROM b0),
    b1 AS (SELECT *, len(past) AS n_history, CASE WHEN len(h) >= 3 THEN list_avg(h) END AS rolling_mean, CASE WHEN len(h) >= 3 THEN list_median(h) END AS rolling_median, CASE WHEN len(h) >= 3 THEN list_stddev_samp(h) END AS rolling_std,
    CASE WHEN len(past) >= 2 THEN list_reduce(past, lambda a, v: 0.5 * v + 0.5 * a) END AS ewma, past[-1] AS previous_period FROM b01),
    b2 AS (SELECT *, coalesce(seasonal, rolling_mean, ewma, previous_period) AS baseline, CASE WHEN seasonal IS NOT NULL THEN 'seasonal' WHEN rolling_mean IS NOT NULL THEN 'rolling_mean' WHEN ewma IS NOT NULL THEN 'ewma' WHEN previous_period IS NOT NULL THEN 'previous_period' END AS method,
    (value - rolling_mean) / nullif(rolling_std, 0) AS z, (value - rolling_median) / nullif(1.4826 * list_median(list_transform(h, lambda x: abs(x - rolling_median))), 0) AS robust_z FROM b1),
    b3 AS (SELECT *, {_mag('baseline')} AS magnitude_tier, {_tier('greatest(abs(z), abs(robust_z)) / 2.0', 1, 1.5, 2.5)} AS statistical_tier, {_tier(f'abs(value - baseline) / {_ABS}', 1, 2, 4)} AS impact_tier,
    list_filter([{', '.join(f'CASE WHEN {x} IS NOT NULL THEN {_mag(x)} END' for x in _BASES)}], lambda x: x IS NOT NULL) AS tiers FROM b2),
    b4 AS (SELECT *, list_sort([magnitude_tier, statistical_tier, impact_tier])[2] AS combined_tier, round((magnitude_tier + statistical_tier + impact_tier) / 9.0::DOUBLE, 3) AS score, value IS NULL OR baseline IS NULL AS missing,
    coalesce(method <> 'seasonal' AND len(tiers) >= 2 AND list_max(tiers) - list_min(tiers) >= 2, false) AS split, n_history < 3 OR sample_size < {_MIN} AS poor FROM b3)"""


def detected(c):
    return Z.materiality(Z.agreement(Z.signals(Z.baselines(monthly(c)))), _ABS, _REL_PCT)


query("g5_primary_baseline", f"WITH {_DETECT} SELECT series_id, period, method, round(baseline, 2) AS baseline FROM b2")(
    lambda c: Z.baselines(monthly(c)).select("series_id", "period", "method", F.round("baseline", 2).alias("baseline"))
)
query(
    "g11_agreement",
    f"WITH {_DETECT} SELECT series_id, period, abs(z - robust_z) <= 1 AS signals_agree, concat_ws(',', CASE "
    "WHEN coalesce(len(h), 0) < 6 THEN 'directional_only' END, CASE WHEN coalesce(len(h), 0) < 3 THEN 'no_percentile' "
    "WHEN len(h) < 10 THEN 'coarse_percentile' END) AS caveats FROM b2",
)(lambda c: detected(c).select("series_id", "period", "signals_agree", "caveats"))
query(
    "g15_tiers",
    f"WITH {_DETECT} SELECT series_id, period, magnitude_tier, statistical_tier, impact_tier, combined_tier, score FROM b4",
)(lambda c: detected(c).select("series_id", "period", "magnitude_tier", "statistical_tier", "impact_tier", "combined_tier", "score"))
query("g17_verdict", f"""WITH {_DETECT} SELECT series_id, period, CASE WHEN missing THEN 'INSUFFICIENT_DATA' WHEN split THEN 'BASELINE_DISAGREEMENT' ELSE ['NORMAL', 'WATCH', 'MATERIAL', 'CRITICAL'][1 + CASE WHEN poor THEN least(combined_tier, 1) ELSE combined_tier END] END AS final_verdict,
    CASE WHEN NOT missing AND NOT split THEN score END AS final_score, NOT missing AND NOT split AND poor AND combined_tier > 1 AS capped FROM b4""")(lambda c: Z.verdict(detected(c), _ABS, _REL_PCT, _MIN).select("series_id", "period", "final_verdict", "final_score", "capped"))
_MV = f"greatest(abs(l.value - b.baseline) / {_ABS}, abs(100 * (l.value - b.baseline) / nullif(b.baseline, 0)) / {_REL_PCT}) >= 1"
_SAME = "(b.value <> b.baseline AND (l.value > b.baseline) = (b.value > b.baseline))"
_PERSIST = f"""o AS (SELECT series_id, period, value, baseline, row_number() OVER (PARTITION BY series_id ORDER BY period) AS k FROM b2),
    j AS (SELECT b.series_id, b.period, b.value, b.baseline, b.k, l.k AS lk, l.value AS lv, {_MV} AS moved, {_SAME} AS same FROM o b LEFT JOIN o l ON l.series_id = b.series_id AND l.k > b.k),
    e AS (SELECT series_id, period, any_value(value) AS value, any_value(baseline) AS baseline, any_value(k) AS k, coalesce(min(lk) FILTER (NOT coalesce(moved AND same, false)), max(lk) + 1) AS stop, bool_or(moved) FILTER (lk = k + 1) AS first_moved, bool_or(same) FILTER (lk = k + 1) AS first_same, max(lv) FILTER (lk = k + 1) AS first FROM j GROUP BY 1, 2),
    r AS (SELECT e.*, stop - e.k - 1 AS run, abs(o.value - e.baseline) AS last FROM e LEFT JOIN o ON o.series_id = e.series_id AND o.k = e.stop - 1 AND e.stop - 1 > e.k),
    pe AS (SELECT series_id, period, CASE WHEN value IS NULL OR baseline IS NULL OR first IS NULL THEN 'UNKNOWN' WHEN NOT first_moved THEN 'ONE_OFF' WHEN NOT first_same THEN 'REVERSING' WHEN 1 + run >= 2 AND last > abs(value - baseline) THEN 'TRENDING' ELSE 'PERSISTENT' END AS persistence,
    CASE WHEN value IS NULL OR baseline IS NULL THEN 0 WHEN first IS NULL OR NOT first_moved OR NOT first_same THEN 1 ELSE 1 + run END AS periods_affected FROM r)"""
query("g18_persistence", f"WITH {_DETECT}, {_PERSIST} SELECT * FROM pe")(
    lambda c: Z.persistence(detected(c), _ABS, _REL_PCT).select("series_id", "period", "persistence", "periods_affected")
)

# full detection: delivery days by order status, with the coverage of every month
_DAYS = """SELECT order_status AS series_id, month AS period, avg(CASE WHEN delivery_data_quality_flag = 'VALID' THEN delivery_days END) AS value,
    count(*) FILTER (delivery_data_quality_flag = 'VALID') AS sample_size, 100.0 * count(*) FILTER (delivery_data_quality_flag = 'VALID') / count(*)::DOUBLE AS coverage FROM order_dates GROUP BY 1, 2"""
_DAY_ABS, _DAY_COVER = 1.0, 80.0
_FULL = f"{_DETECT}, {_PERSIST}".replace(f"ser AS ({_S})", f"ser AS ({_DAYS})").replace(str(_ABS), str(_DAY_ABS)).replace(
    f"sample_size < {_MIN} AS poor",
    f"sample_size < {_MIN} OR coverage < {_DAY_COVER} AS poor",
)


def delivery_series(c):
    valid = F.col("delivery_data_quality_flag") == "VALID"
    return c.order_dates.groupBy(F.col("order_status").alias("series_id"), F.col("month").alias("period")).agg(
        F.avg(F.when(valid, F.col("delivery_days"))).alias("value"),
        F.count_if(valid).alias("sample_size"),
        (100.0 * F.count_if(valid) / F.count("*")).alias("coverage"),
    )


_SHOWN = ("magnitude_tier", "statistical_tier", "impact_tier", "combined_tier")
query("g19_detection", f"""WITH {_FULL} SELECT series_id, period, round(value, 4) AS value, sample_size, round(coverage, 4) AS coverage, method, round(baseline, 4) AS baseline, n_history, round(z, 3) AS z, round(robust_z, 3) AS robust_z,
    {', '.join(_SHOWN)}, poor AS low_quality, CASE WHEN missing THEN 'INSUFFICIENT_DATA' WHEN split THEN 'BASELINE_DISAGREEMENT' ELSE ['NORMAL', 'WATCH', 'MATERIAL', 'CRITICAL'][1 + CASE WHEN poor THEN least(combined_tier, 1) ELSE combined_tier END] END AS final_verdict,
    CASE WHEN NOT missing AND NOT split THEN score END AS final_score, persistence, periods_affected FROM b4 JOIN pe USING (series_id, period)""")(
    lambda c: Z.detect(delivery_series(c), _DAY_ABS, _REL_PCT, _MIN, _DAY_COVER).select(
        "series_id", "period", F.round("value", 4).alias("value"), "sample_size", F.round("coverage", 4).alias("coverage"), "method", F.round("baseline", 4).alias("baseline"), "n_history", F.round("z", 3).alias("z"), F.round("robust_z", 3).alias("robust_z"),
        *_SHOWN, (F.col("low_quality") | (F.col("n_history") < 3)).alias("low_quality"), "final_verdict", "final_score", "persistence", "periods_affected",
    )
)
for _name, _with, _additive, _least, _rows in (("g14_additive_impact", _DETECT, True, _ABS, lambda c: detected(c)), ("g14_rate_impact", _FULL, False, _DAY_ABS, lambda c: Z.materiality(Z.signals(Z.baselines(delivery_series(c))), _DAY_ABS, _REL_PCT))):
    _label = "revenue" if _additive else "avg_delivery_days"
    _IMPACT = f"CASE WHEN missing THEN NULL ELSE round(value - baseline, {2 if _additive else 4}) END"
    query(_name, f"""WITH {_with} SELECT series_id, period, '{'additive' if _additive else 'rate_or_average'}' AS kpi_kind, {_IMPACT} AS magnitude, nullif(sample_size, 0) AS affected_population,
        abs({_IMPACT}) >= {_least} AS meets_minimum, missing AS unknown FROM b4""")(
        lambda c, rows=_rows, additive=_additive, label=_label, least=_least: Z.impact(rows(c), additive, label, least).withColumn("unknown", F.col("interpretation").contains("no impact")).drop("interpretation")
    )


# H
_PVM1 = f"SELECT CASE WHEN sum(q0) = 0 THEN 0 ELSE (sum(q1) - sum(q0)) * sum(r0) / sum(q0) END AS volume, sum(q1 * (coalesce(r1 / nullif(q1, 0), 0) - coalesce(r0 / nullif(q0, 0), 0))) AS price, sum(r1 - r0) AS total FROM (SELECT q0::DOUBLE AS q0, r0::DOUBLE AS r0, q1::DOUBLE AS q1, r1::DOUBLE AS r1 FROM ({_two_sql('product_category')}))"
query("h2_driver_rows", f"""WITH p AS ({_PVM1}), d AS (SELECT 'volume' AS driver, round(volume, 2) AS effect, round(total, 4) AS total FROM p UNION ALL SELECT 'price', round(price, 2), round(total, 4) FROM p UNION ALL SELECT 'mix', round(total - volume - price, 2), round(total, 4) FROM p)
    SELECT driver, effect, round(100 * effect / nullif(abs(total), 0), 2) AS pct_of_change, CASE WHEN effect > 0 THEN 'UP' WHEN effect < 0 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM d""")(lambda c: D.driver_rows(D.pvm(D.two_periods(_items(c, "product_category"), "product_category", _NOW, _WAS))))
query(
    "h9_concurrent_kpis",
    f"WITH {_OVER} SELECT * FROM overview WHERE kpi IN ('orders', 'aov', 'avg_delivery_days', 'on_time_delivery_rate', 'avg_review_score')",
)(lambda c: K.overview(c, _NOW, _WAS).where(F.col("kpi").isin("orders", "aov", "avg_delivery_days", "on_time_delivery_rate", "avg_review_score")))
_T10 = "CASE WHEN cov IS NULL THEN 'UNKNOWN' WHEN cov >= 95 THEN 'HIGH' WHEN cov >= 80 THEN 'MEDIUM' ELSE 'LOW' END"
query("h10_worst_quality", f"""WITH c AS (SELECT order_status, 100.0 * count(item_count) FILTER (month = '{_WAS}') / nullif(count(*) FILTER (month = '{_WAS}'), 0)::DOUBLE AS a, 100.0 * count(*) FILTER (month = '{_NOW}' AND delivery_data_quality_flag = 'VALID') / nullif(count(*) FILTER (month = '{_NOW}'), 0)::DOUBLE AS b
    FROM order_dates LEFT JOIN agg_order_items USING (order_id) WHERE month IN ('{_WAS}', '{_NOW}') GROUP BY 1), t AS (SELECT order_status, {_T10.replace('cov', 'a')} AS previous, {_T10.replace('cov', 'b')} AS current FROM c)
    SELECT *, CASE WHEN 'LOW' IN (previous, current) THEN 'LOW' WHEN 'MEDIUM' IN (previous, current) THEN 'MEDIUM' WHEN 'UNKNOWN' IN (previous, current) THEN 'UNKNOWN' ELSE 'HIGH' END AS worst FROM t""")(
    lambda c: c.order_dates.where(F.col("month").isin(_WAS, _NOW)).join(c.agg_order_items.select("order_id", "item_count"), "order_id", "left").groupBy("order_status").agg(
        F.expr(f"100.0D * count_if(item_count IS NOT NULL AND month = '{_WAS}') / nullif(count_if(month = '{_WAS}'), 0)").alias("a"), F.expr(f"100.0D * count_if(month = '{_NOW}' AND delivery_data_quality_flag = 'VALID') / nullif(count_if(month = '{_NOW}'), 0)").alias("b"))
    .select("order_status", K.quality_tier(F.col("a")).alias("previous"), K.quality_tier(F.col("b")).alias("current")).withColumn("worst", D.worst_tier("previous", "current"))
)
query(
    "h11_contribution_tree",
    f"WITH {_seg_sql()}, r AS (SELECT segment_type, segment_value, row_number() OVER (PARTITION BY segment_type "
    "ORDER BY abs(absolute_change) DESC, segment_value)::INTEGER AS rank FROM seg) "
    "SELECT segment_type, to_json(list(struct_pack(rank := rank, segment_value := segment_value) ORDER BY rank))::VARCHAR AS children "
    "FROM r GROUP BY 1",
)(lambda c: D.contribution_tree(segments(c)))
query("h12_normalised_items", f"SELECT order_id, product_id, coalesce(product_category, 'uncategorized') AS product_category, coalesce(seller_id::VARCHAR, 'unknown_seller') AS seller, coalesce(seller_state, 'unknown_state') AS seller_state, price::DOUBLE AS price FROM kpi_items WHERE month = '{_NOW}'")(
    lambda c: _items(c, "product_category", "seller_state").where(F.col("month") == _NOW).select(
        "order_id",
        "product_id",
        F.coalesce("product_category", F.lit("uncategorized")).alias("product_category"),
        F.coalesce(F.col("seller_id").cast("string"), F.lit("unknown_seller")).alias("seller"),
        F.coalesce("seller_state", F.lit("unknown_state")).alias("seller_state"),
        "price",
    )
)
