"""Queries of groups B, F, G, H and K: profiles, series, baselines, drivers and causal estimates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import drivers as D
from ..operators import kpi as K
from ..operators import profile as P
from ..operators import series as Z
from .sql import Registry

query = Registry()

# B: profiles
_COLS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string"}
query("b1_column_profile", " UNION ALL ".join(f"""SELECT '{x}' AS column, '{t}' AS dtype, count(*) - count({x}) AS nulls, round((count(*) - count({x})) / count(*)::DOUBLE, 6) AS null_rate, count(DISTINCT {x}) AS distinct_count,
    min({x})::VARCHAR AS min, max({x})::VARCHAR AS max, {f'round(avg({x}), 6)' if t == 'bigint' else 'NULL::DOUBLE'} AS mean FROM orders""" for x, t in _COLS.items()))(
    lambda c: P.column_profile(c.raw("orders").select(*(F.col(x).cast(t).alias(x) for x, t in _COLS.items())))
)
query(
    "b2_null_report",
    "SELECT * "
    "FROM (SELECT 'category_name_pt' AS column, count(*) - count(category_name_pt) AS nulls, round((count(*) - count(category_name_pt)) / count(*)::DOUBLE, 6) AS null_rate, count(DISTINCT category_name_pt) AS distinct_count "
    "FROM dim_product UNION ALL "
    "SELECT 'category_name_en', count(*) - count(category_name_en), round((count(*) - count(category_name_en)) / count(*)::DOUBLE, 6), count(DISTINCT category_name_en) "
    "FROM dim_product) WHERE nulls > 0 ORDER BY null_rate DESC, 1",
)(
    lambda c: P.column_profile(
        c.dim_product.select("product_id", "category_name_pt", "category_name_en")
    ).select("column", "nulls", "null_rate", "distinct_count").where("nulls > 0").orderBy(F.desc("null_rate"), "column")
)


def _key_sql(table: str, *key: str) -> str:
    k = ", ".join(key)
    null = " OR ".join(f"{x} IS NULL" for x in key)
    return f"SELECT *, duplicate_rows = 0 AND null_rows = 0 AS is_key FROM (SELECT sum(n)::BIGINT AS rows, count(*) AS unique_combinations, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS duplicate_rows, coalesce(sum(CASE WHEN {null} THEN n END), 0)::BIGINT AS null_rows FROM (SELECT {k}, count(*) AS n FROM {table} GROUP BY {k}))"


query(
    "b3_candidate_key_raw_items",
    _key_sql("lineitem", "l_orderkey", "l_linenumber"),
)(lambda c: P.candidate_key(c.raw("lineitem"), "l_orderkey", "l_linenumber"))
query("b3_candidate_key_orders", _key_sql("orders", "o_orderkey"))(lambda c: P.candidate_key(c.raw("orders"), "o_orderkey"))
query("b4_foreign_key", """SELECT * FROM (SELECT count(DISTINCT o_custkey) AS child_keys, count(*) - count(o_custkey) AS null_rows FROM orders), (SELECT count(DISTINCT c_custkey) AS parent_keys FROM customer),
    (SELECT count(DISTINCT o_custkey) AS orphan_keys, count(*) AS orphan_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")(lambda c: P.foreign_key(c.raw("orders"), "o_custkey", c.raw("customer"), "c_custkey"))
query(
    "b5_cardinality",
    "SELECT round(avg(n), 6) AS mean, median(n) AS median, max(n) AS max, round(100.0 * count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS pct_zero, round(100.0 * count(*) FILTER (n > 1) / count(*)::DOUBLE, 6) AS pct_multiple " "FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)",
)(lambda c: P.cardinality(c.raw("orders"), "o_orderkey", c.raw("lineitem"), "l_orderkey"))
query(
    "b7_date_column",
    "SELECT count(*) FILTER (event_id % 9 > 0) AS parseable, count(*) FILTER (event_id % 9 = 0 AND event_id % 2 > 0) AS failed, count(*) FILTER (event_id % 18 = 0) AS nulls, min(ts) FILTER (event_id % 9 > 0) AS first, max(ts) FILTER (event_id % 9 > 0) AS last "
    "FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)",
)(
    lambda c: P.date_column(
        c.raw("events").selectExpr(
            "CASE WHEN event_id % 18 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'not a date' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS d"
        ),
        "d",
    )
)
_RULES = {"price<=0": "price <= 0", "freight<0": "freight_value < 0", "freight=0": "freight_value = 0"}
query(
    "b8_suspicious_values",
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({t}) AS violations FROM fact_order_items" for n, t in _RULES.items()),
)(lambda c: P.suspicious(c.items, _RULES))
query("b10_days_without_orders", "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(min(purchase_timestamp)::DATE, max(purchase_timestamp)::DATE, INTERVAL 1 DAY)) AS d FROM order_dates) WHERE d NOT IN (SELECT purchase_timestamp::DATE FROM order_dates)")(
    lambda c: c.order_dates.agg(
        F.explode(F.sequence(F.min("purchase_timestamp").cast("date"), F.max("purchase_timestamp").cast("date"))).alias("d")
    ).join(
        c.order_dates.select(F.col("purchase_timestamp").cast("date").alias("d")).distinct(), "d", "left_anti"
    ).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
)
query("b11_fanout_audit", "SELECT correct, naive, round(100 * (naive - correct) / correct, 6) AS inflation_pct FROM (SELECT sum(price)::DOUBLE AS correct FROM fact_order_items), (SELECT sum(price)::DOUBLE AS naive FROM fact_order_items JOIN fact_payments USING (order_id))")(
    lambda c: c.items.agg(F.sum("price").cast("double").alias("correct")).crossJoin(
        c.items.join(c.fact_payments, "order_id").agg(F.sum("price").cast("double").alias("naive"))
    ).withColumn("inflation_pct", F.round(100 * (F.col("naive") - F.col("correct")) / F.col("correct"), 6))
)
_RECON = "SELECT o.order_id, order_status, item_gmv_total AS i, total_payment_value AS p FROM order_dates o LEFT JOIN agg_order_items USING (order_id) LEFT JOIN agg_order_payments USING (order_id)"


def reconciled(c):
    return c.order_dates.select("order_id", "order_status").join(c.agg_order_items.select("order_id", F.col("item_gmv_total").alias("i")), "order_id", "left").join(
        c.agg_order_payments.select("order_id", F.col("total_payment_value").alias("p")),
        "order_id",
        "left",
    )


query("b12_reconciliation", f"SELECT count(*) FILTER (abs(i - p) <= 0.01) AS matched, count(*) FILTER (abs(i - p) > 0.01) AS unmatched, count(*) FILTER (i IS NOT NULL AND p IS NULL) AS only_items, count(*) FILTER (i IS NULL AND p IS NOT NULL) AS only_payments, count(*) FILTER (i IS NULL AND p IS NULL) AS neither FROM ({_RECON})")(
    lambda c: reconciled(c).agg(*(F.count_if(F.expr(t)).alias(n) for n, t in (("matched", "abs(i - p) <= 0.01"), ("unmatched", "abs(i - p) > 0.01"), ("only_items", "i IS NOT NULL AND p IS NULL"), ("only_payments", "i IS NULL AND p IS NOT NULL"), ("neither", "i IS NULL AND p IS NULL"))))
)
query("b14_tolerances", f"SELECT tolerance, count(*) FILTER (abs(i - p) <= tolerance) AS matched, round(count(*) FILTER (abs(i - p) <= tolerance) / count(i)::DOUBLE, 6) AS share FROM ({_RECON}), (VALUES (0.00000001), (0.01), (0.05), (1.0)) t(tolerance) GROUP BY 1", "tolerance")(
    lambda c: reconciled(c).crossJoin(F.broadcast(c.spark.sql("SELECT * FROM VALUES (0.00000001D), (0.01D), (0.05D), (1.0D) t(tolerance)"))).groupBy("tolerance").agg(
        F.count_if(F.expr("abs(i - p) <= tolerance")).alias("matched"),
        F.round(F.try_divide(F.count_if(F.expr("abs(i - p) <= tolerance")), F.count("i")), 6).alias("share"),
    )
)
query("b15_status_summary", f"SELECT order_status, count(*) AS orders, count(i) AS with_items, sum(i)::DECIMAL(18,4) AS gmv, sum(p)::DECIMAL(18,4) AS paid FROM ({_RECON}) GROUP BY 1", "gmv paid")(
    lambda c: reconciled(c).groupBy("order_status").agg(
        F.count("*").alias("orders"),
        F.count("i").alias("with_items"),
        F.sum("i").cast("decimal(18,4)").alias("gmv"),
        F.sum("p").cast("decimal(18,4)").alias("paid"),
    )
)
query(
    "b19_revenue_by_seller_state",
    "SELECT seller_state, sum(price)::DECIMAL(18,4) AS revenue, count(DISTINCT seller_id) AS sellers FROM fact_order_items "
    "JOIN dim_seller USING (seller_id) GROUP BY 1",
    "revenue",
)(
    lambda c: c.items.join(c.dim_seller, "seller_id").groupBy("seller_state").agg(
        F.sum("price").cast("decimal(18,4)").alias("revenue"),
        F.count_distinct("seller_id").alias("sellers"),
    )
)
query("b20_date_anomalies", "SELECT count(*) FILTER (shipping_limit_date > (SELECT max(purchase_timestamp) FROM order_dates)) AS shipped_late, (SELECT count(*) FROM order_dates WHERE customer_delivery_timestamp < purchase_timestamp) AS delivered_before FROM fact_order_items")(
    lambda c: c.items.select("shipping_limit_date").crossJoin(
        F.broadcast(
            c.order_dates.agg(
                F.max("purchase_timestamp").alias("last"),
                F.count_if(F.col("customer_delivery_timestamp") < F.col("purchase_timestamp")).alias("before"),
            )
        )
    ).agg(F.count_if(F.col("shipping_limit_date") > F.col("last")).alias("shipped_late"), F.max("before").alias("delivered_before"))
)
query("b22_reliable_window", "SELECT * FROM win")(lambda c: c.window)
# F and G: series
_MONTHLY = "SELECT product_category AS series_id, month AS period, sum(price)::DOUBLE AS value, count(*) AS sample_size FROM kpi_items GROUP BY ALL"


def monthly(c):
    return summed(c, "product_category").groupBy(
        F.coalesce("product_category", F.lit("none")).alias("series_id"),
        F.col("month").alias("period"),
    ).agg(F.sum("price").cast("double").alias("value"), F.sum("n").alias("sample_size"))


_S = "SELECT coalesce(series_id, 'none') AS series_id, period, value, sample_size FROM (" + _MONTHLY + ")"
_W3 = "OVER (PARTITION BY series_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
query("f2_change_stats", f"""WITH ser AS ({_S}), x AS (SELECT *, 100 * (value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY period), 0) - 1) AS pct_change,
    CASE WHEN count(value) {_W3} >= 2 THEN avg(value) {_W3} END AS roll_mean, CASE WHEN count(value) {_W3} >= 2 THEN stddev(value) {_W3} END AS roll_std FROM ser)
    SELECT series_id, period, round(pct_change, 4) AS pct_change, round(roll_mean, 5) AS roll_mean, round(roll_std, 2) AS roll_std, round((value - roll_mean) / nullif(roll_std, 0), 4) AS roll_z FROM x""")(
    lambda c: Z.change_stats(monthly(c), 3).select("series_id", "period", F.round("pct_change", 4).alias("pct_change"), F.round("roll_mean", 5).alias("roll_mean"), F.round("roll_std", 2).alias("roll_std"), F.round("roll_z", 4).alias("roll_z"))
)
query("f3_material_movements", f"""WITH ser AS ({_S}), x AS (SELECT *, 100 * (value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY period), 0) - 1) AS pct FROM ser)
    SELECT series_id, period, round(pct, 4) AS pct_change FROM x WHERE abs(pct) >= 15 AND sample_size >= 20""")(lambda c: Z.change_stats(monthly(c), 3).where("abs(pct_change) >= 15 AND sample_size >= 20").select("series_id", "period", F.round("pct_change", 4).alias("pct_change")))
query("f4_correlation", "SELECT round(corr(d, s), 6) AS correlation, count(*) AS months FROM (SELECT month, avg(delivery_days) AS d, avg(latest_review_score) AS s, count(*) AS n FROM order_dates LEFT JOIN agg_order_reviews USING (order_id) GROUP BY 1) WHERE n >= 100")(
    lambda c: c.order_dates.join(c.agg_order_reviews.select("order_id", "latest_review_score"), "order_id", "left").groupBy("month").agg(
        F.avg("delivery_days").alias("d"),
        F.avg("latest_review_score").alias("s"),
        F.count("*").alias("n"),
    ).where("n >= 100").agg(F.round(F.corr("d", "s"), 6).alias("correlation"), F.count("*").alias("months"))
)
_H = "OVER (PARTITION BY series_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
_BASE = f"""ser AS ({_S}), b AS (SELECT *, CASE WHEN count(value) {_H} >= 3 THEN avg(value) {_H} END AS rolling_mean, CASE WHEN count(value) {_H} >= 3 THEN median(value) {_H} END AS rolling_median,
    CASE WHEN count(value) {_H} >= 3 THEN stddev(value) {_H} END AS rolling_std, lag(value) OVER (PARTITION BY series_id ORDER BY period) AS previous_period,
    CASE WHEN count(value) OVER y >= 2 THEN avg(value) OVER y END AS seasonal, list(value) {_H} AS h
    FROM ser WINDOW y AS (PARTITION BY series_id, substr(period, 6, 2) ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
query(
    "g2_rolling_baselines",
    f"WITH {_BASE} "
    "SELECT series_id, period, round(rolling_mean, 2) AS rolling_mean, round(rolling_median, 2) AS rolling_median, round(rolling_std, 2) AS rolling_std, round(previous_period, 2) AS previous_period, round(seasonal, 2) AS seasonal "
    "FROM b",
)(
    lambda c: Z.baselines(monthly(c)).select(
        "series_id",
        "period",
        *(F.round(x, 2).alias(x) for x in ("rolling_mean", "rolling_median", "rolling_std", "previous_period", "seasonal")),
    )
)
query("g3_ewma", f"""WITH RECURSIVE ser AS ({_S}), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS k FROM ser),
    e AS (SELECT series_id, k, value AS s FROM o WHERE k = 1 UNION ALL SELECT o.series_id, o.k, 0.5 * o.value + 0.5 * e.s FROM e JOIN o ON o.series_id = e.series_id AND o.k = e.k + 1)
    SELECT o.series_id, o.period, CASE WHEN o.k > 2 THEN round(e.s, 2) END AS ewma FROM o LEFT JOIN e ON e.series_id = o.series_id AND e.k = o.k - 1""")(lambda c: Z.baselines(monthly(c)).select("series_id", "period", F.round("ewma", 2).alias("ewma")))
query("g8_signals", f"""WITH {_BASE}, m AS (SELECT *, 1.4826 * list_median(list_transform(h, lambda x: abs(x - rolling_median))) AS mad FROM b)
    SELECT series_id, period, round((value - rolling_mean) / nullif(rolling_std, 0), 4) AS z, round((value - rolling_median) / nullif(mad, 0), 4) AS robust_z,
    round(100.0 * len(list_filter(h, lambda x: x <= value)) / len(h)::DOUBLE, 4) AS percentile FROM m""")(lambda c: Z.signals(Z.baselines(monthly(c))).select("series_id", "period", *(F.round(x, 4).alias(x) for x in ("z", "robust_z", "percentile"))))
# H: drivers
_NOW, _WAS = "2001-06", "2001-05"


def _items(c, *dims):
    return K.Kpi(c, window=False).items(list(dims))


def item_sums(c):
    """n and price of the items by month and the dimensions of segments; written once, for they hold what all evidence of items needs."""
    return c.stored("item sums", lambda: _items(c, *_SEG).groupBy("month", *_SEG).agg(F.count("*").alias("n"), F.sum("price").alias("price")))


def summed(c, *dims):
    """n and price of the items by month and dims: of item_sums where the query has written them, else of the items."""
    if c.has("item sums"):
        return item_sums(c).groupBy("month", *dims).agg(F.sum("n").alias("n"), F.sum("price").alias("price"))
    return _items(c, *dims).groupBy("month", *dims).agg(F.count("*").alias("n"), F.sum("price").alias("price"))


def _two_sql(key: str) -> str:
    return f"SELECT {key} AS k, count(*) FILTER (month = '{_WAS}') AS q0, coalesce(sum(price) FILTER (month = '{_WAS}'), 0) AS r0, count(*) FILTER (month = '{_NOW}') AS q1, coalesce(sum(price) FILTER (month = '{_NOW}'), 0) AS r1 FROM kpi_items WHERE month IN ('{_WAS}', '{_NOW}') GROUP BY 1"


_PVM = """round(sum(r1 - r0), 4) AS total_change, round(CASE WHEN sum(q0) = 0 THEN 0 ELSE (sum(q1) - sum(q0)) * sum(r0) / sum(q0) END, 2) AS volume_effect,
    round(sum(q1 * (coalesce(r1 / nullif(q1, 0), 0) - coalesce(r0 / nullif(q0, 0), 0))), 2) AS price_effect,
    round(sum(r1 - r0) - CASE WHEN sum(q0) = 0 THEN 0 ELSE (sum(q1) - sum(q0)) * sum(r0) / sum(q0) END - sum(q1 * (coalesce(r1 / nullif(q1, 0), 0) - coalesce(r0 / nullif(q0, 0), 0))), 2) AS mix_effect,
    CASE WHEN sum(q0) >= 30 AND sum(q1) >= 30 THEN 'HIGH' ELSE 'LOW' END AS confidence"""
query(
    "h1_pvm_bridge",
    f"SELECT {_PVM} FROM (SELECT q0::DOUBLE AS q0, r0::DOUBLE AS r0, q1::DOUBLE AS q1, r1::DOUBLE AS r1 FROM ({_two_sql('product_category')}))",
)(lambda c: D.pvm(D.two_periods(_items(c, "product_category"), "product_category", _NOW, _WAS)))
query("h14_monthly_pvm", f"""WITH m AS (SELECT month, product_category AS k, count(*)::DOUBLE AS q, sum(price)::DOUBLE AS r FROM kpi_items GROUP BY ALL),
    g AS (SELECT month, k, 0 AS q0, 0 AS r0, q AS q1, r AS r1 FROM m UNION ALL SELECT strftime((month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m'), k, q, r, 0, 0 FROM m),
    s AS (SELECT month, k, sum(q0) AS q0, sum(r0) AS r0, sum(q1) AS q1, sum(r1) AS r1 FROM g GROUP BY ALL)
    SELECT month, {_PVM} FROM s WHERE month IN (SELECT month FROM m) GROUP BY month""")(lambda c: D.monthly_pvm(_items(c, "product_category"), "product_category"))
_SEG = {"product_category": "product_category", "customer_state": "customer_state", "seller_state": "seller_state"}


def segments(c):
    """Segment contributions of both months; written once, for many queries read them more than once."""
    labelled = lambda: item_sums(c).withColumns({k: F.coalesce(k, F.lit("uncategorized" if k == "product_category" else "unknown_state")) for k in _SEG})
    return c.stored("segments", lambda: D.segment_contributions(labelled(), [*_SEG], _NOW, _WAS, "n"))


def _seg_sql() -> str:
    parts = []
    for kind in _SEG:
        key = f"coalesce({kind}, '{'uncategorized' if kind == 'product_category' else 'unknown_state'}')"
        parts.append(
            f"SELECT '{kind}' AS segment_type, x.*, coalesce(months, 0) AS months FROM ({_two_sql(key)}) x LEFT "
            f"JOIN (SELECT {key} AS k, count(DISTINCT month) AS months FROM kpi_items WHERE month <= '{_WAS}' GROUP BY 1) USING (k)"
        )
    return f"""seg AS (SELECT segment_type, k AS segment_value, r0::DOUBLE AS previous, r1::DOUBLE AS current, (r1 - r0)::DOUBLE AS absolute_change, round(100 * (r1 - r0)::DOUBLE / nullif(r0::DOUBLE, 0), 4) AS percent_change,
        round(100 * (r1 - r0)::DOUBLE / nullif((sum(r1 - r0) OVER (PARTITION BY segment_type))::DOUBLE, 0), 4) AS share_of_total, q0 + q1 AS sample_size, months AS history_months,
        CASE WHEN months >= 6 AND q0 + q1 >= 30 THEN 'HIGH' WHEN months >= 2 OR q0 + q1 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ({' UNION ALL '.join(parts)}))"""


query("h3_segment_contributions", f"WITH {_seg_sql()} SELECT * FROM seg")(segments)
query(
    "h6_ranked_segments",
    f"WITH {_seg_sql()} SELECT * FROM (SELECT segment_type, segment_value, absolute_change, row_number() OVER (PARTITION BY segment_type "
    "ORDER BY abs(absolute_change) DESC, segment_value)::INTEGER AS rank FROM seg) WHERE rank <= 5",
)(lambda c: D.ranked(segments(c)).where("rank <= 5").select("segment_type", "segment_value", "absolute_change", "rank"))
query(
    "h7_dimension_ranking",
    f"WITH {_seg_sql()} SELECT segment_type, max(abs(absolute_change)) AS max_contribution, first(segment_value " "ORDER BY abs(absolute_change) DESC, segment_value DESC) AS top_segment, round(sum(abs(absolute_change)), 4) AS total_contribution, count(*) AS segments " "FROM seg GROUP BY 1",
)(lambda c: D.dimension_ranking(segments(c)).withColumn("total_contribution", F.round(F.col("total_contribution").cast("double"), 4)))
query(
    "h8_reconciliation",
    f"WITH {_seg_sql()}, s AS (SELECT segment_type, round(sum(absolute_change), 4) AS sum_change FROM seg GROUP BY 1), "
    f"t AS (SELECT coalesce(sum(price) FILTER (month = '{_NOW}'), 0) - coalesce(sum(price) FILTER (month = '{_WAS}'), 0) AS change FROM kpi_items) "
    "SELECT s.*, round(change::DOUBLE - sum_change, 4) AS distance, abs(round(change::DOUBLE - sum_change, 4)) <= 0.01 AS reconciled FROM s, t",
)(lambda c: D.reconciliation(segments(c), D.change(_items(c), _NOW, _WAS)).withColumn("sum_change", F.round(F.col("sum_change").cast("double"), 4)))

# K: causal estimates
_K2 = "SELECT customer_state AS segment, month >= '1998-01' AS post, customer_state < 'NATION_2' AS treated, price FROM kpi_items"
query("k2_did", f"SELECT round((avg(price) FILTER (treated AND post) - avg(price) FILTER (treated AND NOT post)) - (avg(price) FILTER (NOT treated AND post) - avg(price) FILTER (NOT treated AND NOT post)), 4) AS did FROM (SELECT treated, post, price::DOUBLE AS price FROM ({_K2}))")(
    lambda c: (
        lambda x: x.agg(
            F.round(
                (F.avg(F.when(F.col("t") & F.col("post"), F.col("v"))) - F.avg(F.when(F.col("t") & ~F.col("post"), F.col("v")))) - (
                    F.avg(F.when(~F.col("t") & F.col("post"), F.col("v"))) - F.avg(F.when(~F.col("t") & ~F.col("post"), F.col("v")))
                ),
                4,
            ).alias("did")
        )
    )(
        _items(c, "customer_state").select(
            (F.col("customer_state") < "NATION_2").alias("t"),
            (F.col("month") >= "1998-01").alias("post"),
            F.col("price").cast("double").alias("v"),
        )
    )
)
_T = "SELECT coalesce(series_id, 'none') AS series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY period)::DOUBLE AS t FROM (" + _MONTHLY + ")"


def _timed(c):
    return monthly(c).withColumn("t", F.row_number().over(Window.partitionBy("series_id").orderBy("period")).cast("double"))


query("k4_trend", f"SELECT series_id, round(regr_slope(value, t), 3) AS slope, round(regr_intercept(value, t), 2) AS intercept FROM ({_T}) GROUP BY 1")(
    lambda c: _timed(c).groupBy("series_id").agg(
        F.round(F.regr_slope("value", "t"), 3).alias("slope"),
        F.round(F.regr_intercept("value", "t"), 2).alias("intercept"),
    )
)
query("k5_interrupted_series", f"""WITH x AS (SELECT series_id, regr_slope(value, t) FILTER (t <= 40) AS s0, regr_intercept(value, t) FILTER (t <= 40) AS i0, regr_slope(value, t) FILTER (t > 40) AS s1, regr_intercept(value, t) FILTER (t > 40) AS i1 FROM ({_T}) GROUP BY 1)
    SELECT series_id, round(i1 + s1 * 41 - (i0 + s0 * 41), 2) AS level_shift, round(s1 - s0, 3) AS slope_change, round(s0, 3) AS pre_slope FROM x""")(
    lambda c: _timed(c).groupBy("series_id").agg(*(f(F.when(cond, F.col("value")), F.when(cond, F.col("t"))).alias(n) for n, f, cond in (("s0", F.regr_slope, F.col("t") <= 40), ("i0", F.regr_intercept, F.col("t") <= 40), ("s1", F.regr_slope, F.col("t") > 40), ("i1", F.regr_intercept, F.col("t") > 40)))).select("series_id", F.round(F.expr("i1 + s1 * 41 - (i0 + s0 * 41)"), 2).alias("level_shift"), F.round(F.expr("s1 - s0"), 3).alias("slope_change"), F.round("s0", 3).alias("pre_slope"))
)
