"""Further queries of groups B, E, F, H, J and L."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as K
from .analytics import _NOW, _WAS, _items, reconciled
from .sql import Registry

query = Registry()

query("b13_reconciliation_by_type", """SELECT payment_type, count(*) AS orders, round(avg(d), 6) AS mean_diff, max(d) AS max_diff, round(avg((d > 0)::INTEGER), 6) AS share_over FROM (
    SELECT o.order_id, payment_type, (total_payment_value - item_gmv_total)::DOUBLE AS d FROM agg_order_items o JOIN agg_order_payments USING (order_id)
    JOIN (SELECT order_id, first(payment_type ORDER BY payment_value DESC, payment_sequential DESC) AS payment_type FROM fact_payments GROUP BY 1) USING (order_id)) GROUP BY 1""")(
    lambda c: c.agg_order_items.join(c.agg_order_payments, "order_id").join(c.fact_payments.groupBy("order_id").agg(F.max_by("payment_type", F.struct("payment_value", "payment_sequential")).alias("payment_type")), "order_id").withColumn("d", F.expr("double(total_payment_value - item_gmv_total)")).groupBy("payment_type").agg(F.count("*").alias("orders"), F.round(F.avg("d"), 6).alias("mean_diff"), F.max("d").alias("max_diff"), F.round(F.avg(F.expr("int(d > 0)")), 6).alias("share_over"))
)
#: Instalments: (from, to] of each bucket.
_BUCKETS = ((-1, 0), (0, 1), (1, 3), (3, 6), (6, 12), (12, 100))
_BUCKET = "CASE " + " ".join(f"WHEN max_installments > {a} AND max_installments <= {b} THEN '({a}, {b}]'" for a, b in _BUCKETS) + " END"
_DIFF = {
    "mean_diff": ("round(avg(d), 6)", "round(avg(d), 6)"), "median_diff": ("round(median(d), 6)", "round(median(d), 6)"), "p90_diff": ("round(quantile_cont(d, 0.9), 6)", "round(percentile(d, 0.9), 6)"), "max_diff": ("max(d)", "max(d)"),
    "share_over": ("round(avg((d > 0)::INTEGER), 6)", "round(avg(int(d > 0)), 6)"), "share_under": ("round(avg((d < 0)::INTEGER), 6)", "round(avg(int(d < 0)), 6)"), "share_equal": ("round(avg((d = 0)::INTEGER), 6)", "round(avg(int(d = 0)), 6)"),
}
_PAID = "SELECT order_id, (total_payment_value - item_gmv_total)::DOUBLE AS d, max_installments FROM agg_order_items JOIN agg_order_payments USING (order_id)"


def differences(c):
    return c.agg_order_items.join(c.agg_order_payments, "order_id").selectExpr(
        "order_id",
        "double(total_payment_value - item_gmv_total) AS d",
        "max_installments",
    )


query(
    "b13_reconciliation_by_installments",
    f"SELECT {_BUCKET} AS bucket, count(*) AS orders, {', '.join(f'{e} AS {n}' for n, (e, _) in _DIFF.items())} FROM ({_PAID}) GROUP BY 1",
)(
    lambda c: differences(c).groupBy(F.expr(_BUCKET).alias("bucket")).agg(
        F.count("*").alias("orders"),
        *(F.expr(e).alias(n) for n, (_, e) in _DIFF.items()),
    )
)
query(
    "b13_largest_differences",
    f"SELECT order_id, d FROM ({_PAID}) ORDER BY abs(d) DESC, order_id LIMIT 15",
)(lambda c: differences(c).select("order_id", "d").orderBy(F.desc(F.abs("d")), "order_id").limit(15))
query("b17_revenue_definitions", "SELECT sum(item_price_total)::DOUBLE AS items_all, sum(item_gmv_total)::DOUBLE AS gmv_all, sum(total_payment_value)::DOUBLE AS paid_all, (sum(item_price_total) FILTER (order_status = 'delivered'))::DOUBLE AS items_delivered FROM order_dates LEFT JOIN agg_order_items USING (order_id) LEFT JOIN agg_order_payments USING (order_id)")(
    lambda c: c.order_dates.select("order_id", "order_status").join(c.agg_order_items, "order_id", "left").join(c.agg_order_payments, "order_id", "left").agg(
        F.sum("item_price_total").alias("items_all"),
        F.sum("item_gmv_total").alias("gmv_all"),
        F.sum("total_payment_value").alias("paid_all"),
        F.sum(F.when(F.col("order_status") == "delivered", F.col("item_price_total"))).alias("items_delivered"),
    )
)
query("b23_review_dedup", "SELECT round(avg(latest), 6) AS latest, round(avg(earliest), 6) AS earliest, round(avg(highest), 6) AS highest, round(avg(mean), 6) AS per_order_mean FROM (SELECT order_id, last(review_score ORDER BY review_answer_timestamp, review_row_id) AS latest, first(review_score ORDER BY review_creation_date, review_row_id) AS earliest, max(review_score) AS highest, avg(review_score) AS mean FROM fact_reviews GROUP BY 1)")(
    lambda c: c.fact_reviews.groupBy("order_id").agg(F.max_by("review_score", F.struct("review_answer_timestamp", "review_row_id")).alias("latest"), F.min_by("review_score", F.struct("review_creation_date", "review_row_id")).alias("earliest"), F.max("review_score").alias("highest"), F.avg("review_score").alias("mean")).agg(*(F.round(F.avg(a), 6).alias(b) for a, b in (("latest", "latest"), ("earliest", "earliest"), ("highest", "highest"), ("mean", "per_order_mean"))))
)
query(
    "e13_kpi_timeseries",
    "SELECT month, sum(price)::DOUBLE AS revenue, count(*) AS quantity, count(DISTINCT order_id) AS orders FROM kpi_items "
    "WHERE in_analytical_window AND month BETWEEN '1998-01' AND '1999-12' GROUP BY 1",
)(
    lambda c: K.Kpi(c, "1998-01-01", "1999-12-31").items([]).groupBy("month").agg(
        F.sum("price").alias("revenue"),
        F.count("*").alias("quantity"),
        F.count_distinct("order_id").alias("orders"),
    )
)
query(
    "f1_gap_filled_months",
    """WITH o AS (SELECT month, customer_state, order_id, purchase_timestamp FROM order_dates LEFT JOIN dim_customer USING (customer_id)),
    m AS (SELECT unnest(generate_series(date_trunc('month', min(purchase_timestamp)), date_trunc('month', max(purchase_timestamp)), INTERVAL 1 MONTH)) AS d FROM o),
    f AS (SELECT month, customer_state, count(*) AS orders, sum(item_price_total)::DOUBLE AS revenue FROM o LEFT JOIN agg_order_items USING (order_id) GROUP BY 1, 2)
    SELECT s.customer_state, strftime(d, '%Y-%m') AS period, coalesce(orders, 0) AS orders, revenue
    FROM m CROSS JOIN (SELECT DISTINCT customer_state FROM f) s LEFT JOIN f ON month = strftime(d, '%Y-%m') AND s.customer_state IS NOT DISTINCT FROM f.customer_state""",
)(lambda c: gap_filled(c))


def gap_filled(c):
    """Orders and revenue by state for every month of the calendar, months without orders included."""
    orders = c.order_dates.join(c.dim_customer.select("customer_id", "customer_state"), "customer_id", "left")
    seen = orders.join(c.agg_order_items.select("order_id", "item_price_total"), "order_id", "left")
    cells = seen.groupBy("customer_state", F.trunc("purchase_timestamp", "month").alias("d")).agg(
        F.count("*").alias("orders"),
        F.sum("item_price_total").alias("revenue"),
    )
    ends = cells.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    spans = cells.select("customer_state").distinct().crossJoin(F.broadcast(ends))
    calendar = spans.select("customer_state", F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("d"))
    on = calendar["d"].eqNullSafe(cells["d"]) & calendar["customer_state"].eqNullSafe(cells["customer_state"])
    out = calendar.join(cells, on, "left")
    return out.select(
        calendar["customer_state"],
        F.date_format(calendar["d"], "yyyy-MM").alias("period"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
        "revenue",
    )


query("h5_history_periods", f"SELECT coalesce(seller_state, 'unknown_state') AS segment, count(DISTINCT month) AS months FROM kpi_items WHERE month <= '{_WAS}' GROUP BY 1")(
    lambda c: _items(c, "seller_state").where(F.col("month") <= _WAS).groupBy(
        F.coalesce("seller_state", F.lit("unknown_state")).alias("segment")
    ).agg(F.count_distinct("month").alias("months"))
)
query(
    "b15_reconciliation_by_status",
    "SELECT order_status, count(*) AS orders, count(*) FILTER (abs(total_payment_value - item_gmv_total) <= 0.01) AS matched "
    "FROM order_dates JOIN agg_order_items USING (order_id) JOIN agg_order_payments USING (order_id) GROUP BY 1",
)(
    lambda c: reconciled(c).where("i IS NOT NULL AND p IS NOT NULL").groupBy("order_status").agg(
        F.count("*").alias("orders"),
        F.count_if(F.expr("abs(i - p) <= 0.01")).alias("matched"),
    )
)
