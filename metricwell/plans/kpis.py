"""Further queries of groups A, C and E: key gates, the default range, variants and details of KPIs, time and item dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as K
from ..operators.canonical import require_unique
from .canonical import _TIER, _VALID, _W
from .sql import Registry

query = Registry()
_ROUNDED = ("value", "coverage")


def kpi(name: str, kpi_id: str, dims: list[str], sql: str, **options) -> None:
    """Registers a KPI with all its details against sql, which gives everything but the quality tier."""

    def run(c):
        out = K.Kpi(c).compute(kpi_id, dims, details=True, **options)
        return out.withColumn("value", F.round(F.col("value").cast("double"), 4)).withColumn("coverage", F.round("coverage", 6))

    query(name, f"SELECT *, {_TIER} FROM ({sql})")(run)


# A: composite keys are gates, not assumptions
query(
    "a8_unique_item_keys",
    "SELECT order_id, order_item_id, price FROM fact_order_items",
    "price",
)(lambda c: require_unique(c.fact_order_items, "order_id", "order_item_id").select("order_id", "order_item_id", "price"))
query(
    "a8_unique_payment_keys",
    "SELECT order_id, payment_sequential, payment_value FROM fact_payments",
    "payment_value",
)(lambda c: require_unique(c.fact_payments, "order_id", "payment_sequential").select("order_id", "payment_sequential", "payment_value"))

# C: the range that holds where no dates are given
query(
    "c6_default_range",
    """SELECT order_id, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(end_day, '%Y-%m-%d') AS last_day FROM order_dates,
    (SELECT (first_month || '-01')::DATE AS first_day, last_day((last_month || '-01')::DATE) AS end_day FROM win)
    WHERE purchase_timestamp >= first_day AND purchase_timestamp < end_day + 1""",
)(lambda c: K.in_default_range(c, c.order_dates).select("order_id", "first_day", "last_day"))

# E: details and variants
_REVIEWS = f"(SELECT r.*, customer_state, strftime(review_creation_date, '%Y-%m') AS month FROM fact_reviews r JOIN (SELECT order_id, customer_state, {_W} FROM fact_orders) USING (order_id) WHERE {_W})"
_EXCLUDED = """count(*) FILTER (delivery_data_quality_flag = 'INVALID_SEQUENCE') AS excluded_invalid,
    count(*) FILTER (delivery_data_quality_flag LIKE 'MISSING%') AS excluded_missing, count(*) AS total_in_scope"""
_COVERED = f"count(*) FILTER ({_VALID}) AS sample_size, round(100.0 * count(*) FILTER ({_VALID}) / count(*)::DOUBLE, 6) AS coverage"
kpi("e6_delivery_days_details", "avg_delivery_days", ["customer_state"], f"""SELECT customer_state,
    round(avg(CASE WHEN {_VALID} THEN delivery_days END), 4) AS value, {_COVERED}, {_EXCLUDED} FROM fact_orders WHERE {_W} GROUP BY 1""")  # fmt: skip
kpi("e7_on_time_details", "on_time_delivery_rate", ["month"], f"""SELECT month,
    round(count(*) FILTER ({_VALID} AND delivery_delay_days <= 0) / nullif(count(*) FILTER ({_VALID}), 0)::DOUBLE, 4) AS value,
    count(*) FILTER ({_VALID} AND delivery_delay_days <= 0) AS numerator, {_COVERED}, {_EXCLUDED} FROM fact_orders WHERE {_W} GROUP BY 1""")  # fmt: skip
kpi("e8_review_score", "avg_review_score", [], f"""SELECT round(avg(latest_review_score), 4) AS value, count(latest_review_score) AS sample_size,
    round(100.0 * count(latest_review_score) / count(*)::DOUBLE, 6) AS coverage, count(*) AS eligible FROM fact_orders LEFT JOIN agg_order_reviews USING (order_id) WHERE {_W}""")  # fmt: skip
kpi("e8_review_score_true_average", "avg_review_score", ["customer_state"], f"""SELECT customer_state, round(avg(avg_review_score), 4) AS value,
    count(avg_review_score) AS sample_size, NULL::DOUBLE AS coverage, count(*) AS eligible
    FROM fact_orders LEFT JOIN agg_order_reviews USING (order_id) WHERE {_W} GROUP BY 1""", variant="order_level_true_average")  # fmt: skip
kpi("e8_review_score_review_level", "avg_review_score", [], f"""SELECT round(avg(review_score), 4) AS value, count(*) AS sample_size,
    CASE WHEN count(*) > 0 THEN 100.0::DOUBLE END AS coverage FROM {_REVIEWS}""", variant="review_level_average")  # fmt: skip
kpi("e9_review_volume_details", "review_volume", ["month", "customer_state"], f"""SELECT month, customer_state, count(*)::DOUBLE AS value,
    count(*) AS sample_size, 100.0::DOUBLE AS coverage, count(DISTINCT order_id) AS distinct_orders FROM {_REVIEWS} GROUP BY 1, 2""")  # fmt: skip
kpi("e9_review_volume_with_text", "review_volume", [], f"""SELECT count(*)::DOUBLE AS value, count(*) AS sample_size, 100.0::DOUBLE AS coverage,
    count(DISTINCT order_id) AS distinct_orders FROM {_REVIEWS} WHERE has_text""", has_text=True)  # fmt: skip
kpi("e10_repeat_purchase_details", "repeat_purchase_rate", [], """SELECT round(count(*) FILTER (n >= 2) / count(*)::DOUBLE, 4) AS value,
    count(*) AS sample_size, count(*) FILTER (n >= 2) AS repeat_customers, 100.0::DOUBLE AS coverage,
    CASE WHEN count(*) < 1000000000 THEN count(*) || ' customers, below the least of 1000000000' END AS warning
    FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM fact_orders GROUP BY 1)""", minimum=1_000_000_000)  # fmt: skip

# E11: time and item dimensions
_DAY = "strftime(purchase_timestamp, '%Y-%m-%d')"
_END = "(purchase_timestamp::DATE + ((8 - isodow(purchase_timestamp)) % 7)::INTEGER)"
_WEEK = f"strftime({_END} - 6, '%Y-%m-%d') || '/' || strftime({_END}, '%Y-%m-%d')"
_REACH = f"round((SELECT 100.0 * count(*) FILTER (has_items) / nullif(count(*), 0)::DOUBLE FROM fact_orders WHERE {_W}), 6) AS coverage"
kpi("e11_orders_by_day", "orders", ["day"], f"""SELECT {_DAY} AS day, count(DISTINCT order_id)::DOUBLE AS value, count(*) AS sample_size,
    100.0::DOUBLE AS coverage FROM fact_orders WHERE {_W} GROUP BY 1""")  # fmt: skip
kpi("e11_quantity_by_week", "quantity_sold", ["week"], f"""SELECT {_WEEK} AS week, count(*)::DOUBLE AS value, count(*) AS sample_size,
    100.0::DOUBLE AS coverage FROM kpi_items WHERE {_W} GROUP BY 1""")  # fmt: skip
kpi("e11_revenue_by_product", "revenue", ["product"], f"""SELECT product_id AS product, round(sum(price)::DOUBLE, 4) AS value,
    count(*) AS sample_size, {_REACH} FROM kpi_items WHERE {_W} GROUP BY 1""")  # fmt: skip
kpi("e11_freight_by_seller_and_month", "freight_revenue", ["seller", "month"], f"""SELECT seller_id AS seller, month,
    round(sum(freight_value)::DOUBLE, 4) AS value, count(*) AS sample_size, {_REACH} FROM kpi_items WHERE {_W} GROUP BY 1, 2""")  # fmt: skip
