"""Queries of groups B and F: full-row duplicates, identity, coverage, sparse histories, segments, distributions, spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as K
from ..operators import profile as P
from .analytics import _NOW, _WAS
from .sql import Registry

query = Registry()

# B1: whole rows, of each table
_TABLES = ("customer", "orders", "lineitem", "events", "documents")
query("b1_duplicate_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows FROM {t}" for t in _TABLES))(
    lambda c: _union(P.duplicate_rows(c.raw(t)).select(F.lit(t).alias("table_name"), "rows", "duplicate_rows") for t in _TABLES)
)


def _union(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


# B9
query("b9_customer_identity", " UNION ALL ".join(f"SELECT '{n}' AS measure, members, count(*) AS groups FROM (SELECT {g}, count(DISTINCT {m}) AS members FROM {t} GROUP BY 1) GROUP BY 2" for n, t, g, m in (
    ("ids_per_person", "dim_customer", "customer_unique_id", "customer_id"), ("orders_per_id", "order_dates", "customer_id", "order_id"), ("orders_per_person", "order_dates", "customer_unique_id", "order_id"))))(lambda c: _union(
    P.repeats_of(rows, g, m).select(F.lit(n).alias("measure"), "members", "groups") for n, rows, g, m in (("ids_per_person", c.dim_customer, "customer_unique_id", "customer_id"), ("orders_per_id", c.orders, "customer_id", "order_id"), ("orders_per_person", c.orders, "customer_unique_id", "order_id"))
))

# B10
_DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
query("b10_temporal_coverage", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{g}' AS grain, strftime({x}, '{p}') AS period, count(*) AS n FROM {t} WHERE {x} IS NOT NULL GROUP BY 3""" for t, x in _DATED.items() for g, p in (("month", "%Y-%m"), ("year", "%Y"))) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{t}', 'day', strftime(d, '%Y-%m-%d'), 0 FROM (SELECT unnest(generate_series(min({x})::DATE, max({x})::DATE, INTERVAL 1 DAY)) AS d FROM {t}) WHERE d NOT IN (SELECT {x}::DATE FROM {t} WHERE {x} IS NOT NULL)" for t, x in _DATED.items()))(
    lambda c: P.temporal_coverage({t: (c.raw(t), x) for t, x in _DATED.items()})
)

# B16: four factors in one pass
_INSTALMENTS = "CASE WHEN max_installments <= 1 THEN '1' WHEN max_installments <= 3 THEN '2-3' WHEN max_installments <= 6 THEN '4-6' ELSE '7+' END"
_FACTORS = ("voucher", "multi_payment", "multi_item", "instalments")
_B16 = f"SELECT i.order_id, abs(item_gmv_total - total_payment_value) > 0.01 AS bad, payment_types LIKE '%voucher%' AS voucher, payment_count > 1 AS multi_payment, item_count > 1 AS multi_item, {_INSTALMENTS} AS instalments FROM agg_order_items i JOIN agg_order_payments p ON i.order_id = p.order_id"
query("b16_mismatch_rates", f"SELECT {', '.join(_FACTORS)}, count(*) AS orders, round(avg(bad::INTEGER), 6) AS rate FROM ({_B16}) GROUP BY GROUPING SETS ({', '.join(f'({f})' for f in _FACTORS)})")(
    lambda c: c.agg_order_items.join(c.agg_order_payments, "order_id").selectExpr("int(abs(item_gmv_total - total_payment_value) > 0.01) AS bad", "payment_types LIKE '%voucher%' AS voucher", "payment_count > 1 AS multi_payment", "item_count > 1 AS multi_item", f"{_INSTALMENTS} AS instalments")
    .groupingSets([[f] for f in _FACTORS], *_FACTORS).agg(F.count("*").alias("orders"), F.round(F.avg("bad"), 6).alias("rate"))
)

# B18, B25
_SPARSE = {"product": ("product_id", "dim_product", "product_id"), "seller": ("seller_id", "dim_seller", "seller_id"), "category": ("category", "(SELECT coalesce(category_name_en, category_name_pt) AS category FROM dim_product)", "category")}
_UNDER = ", ".join(f"count(*) FILTER (n < {v}) AS under_{v}, round(avg((n < {v})::INTEGER), 6) AS share_under_{v}" for v in (30, 90, 180))
_OF = "(SELECT i.*, coalesce(category_name_en, category_name_pt) AS category FROM fact_order_items i LEFT JOIN dim_product USING (product_id))"
query("b18_sparse_history", " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS entities, {_UNDER}, median(n) AS median, (SELECT count(DISTINCT {o}) FROM {t} WHERE {o} IS NOT NULL AND {o} NOT IN (SELECT {k} FROM {_OF} WHERE {k} IS NOT NULL)) AS without_rows FROM (SELECT {k}, count(*) AS n FROM {_OF} WHERE {k} IS NOT NULL GROUP BY 1)" for n, (k, t, o) in _SPARSE.items()))(
    lambda c: P.sparse_history(_entities(c))
)


def _entities(c):
    named = F.coalesce("category_name_en", "category_name_pt").alias("category")
    products = c.dim_product.select("product_id", named)
    items = c.items.join(products, "product_id", "left")
    return {"product": (items, "product_id", c.dim_product, "product_id"), "seller": (items, "seller_id", c.dim_seller, "seller_id"), "category": (items, "category", products, "category")}


query("b25_observation_histogram", " UNION ALL ".join(f"SELECT '{k}' AS entity, least(n, {v}) AS observations, count(*) AS entities FROM (SELECT {k}, count(*) AS n FROM fact_order_items GROUP BY 1) GROUP BY 2" for k, v in (("product_id", 50), ("seller_id", 200))))(
    lambda c: _union(P.histogram(c.items, k, v).select(F.lit(k).alias("entity"), "observations", "entities") for k, v in (("product_id", 50), ("seller_id", 200)))
)

# B19: how many values the segments have, orders by customers' state, and what the 20 largest sellers hold
_DIMS = {"product_id": "fact_order_items", "seller_id": "fact_order_items", "seller_state": "dim_seller", "customer_state": "dim_customer", "category_name_en": "dim_product"}
query("b19_segment_cardinality", " UNION ALL ".join(f"SELECT '{x}' AS dimension, count(DISTINCT {x}) AS n FROM {t}" for x, t in _DIMS.items()))(
    lambda c: _union({"fact_order_items": c.items, "dim_seller": c.dim_seller, "dim_customer": c.dim_customer, "dim_product": c.dim_product}[t].agg(F.count_distinct(x).alias("n")).select(F.lit(x).alias("dimension"), "n") for x, t in _DIMS.items())
)
query("b19_orders_by_customer_state", "SELECT customer_state, count(DISTINCT order_id) AS orders FROM order_dates LEFT JOIN dim_customer USING (customer_id) GROUP BY 1")(
    lambda c: c.orders.join(c.dim_customer.select("customer_id", "customer_state"), "customer_id", "left").groupBy("customer_state").agg(F.count_distinct("order_id").alias("orders"))
)
query("b19_top_seller_share", "SELECT count(*) FILTER (n <= 20) AS sellers, round((sum(r) FILTER (n <= 20) / sum(r))::DOUBLE, 6) AS share FROM (SELECT r, row_number() OVER (ORDER BY r DESC, seller_id) AS n FROM (SELECT seller_id, sum(price)::DOUBLE AS r FROM fact_order_items GROUP BY 1))")(lambda c: top_share(c))


def top_share(c, k: int = 20):
    """The share of revenue of the k largest sellers."""
    each = c.items.groupBy("seller_id").agg(F.sum("price").cast("double").alias("r"))
    top = each.orderBy(F.desc("r"), "seller_id").limit(k).agg(F.count("*").alias("sellers"), F.sum("r").alias("t"))
    return top.crossJoin(F.broadcast(each.agg(F.sum("r").alias("a")))).select("sellers", F.round(F.try_divide("t", "a"), 6).alias("share"))


# B21
_COVER = {"items": "item_price_total", "delivery": "customer_delivery_timestamp", "review": "latest_review_score"}
query("b21_monthly_reliability", f"""SELECT month, count(*) AS orders, sum(item_price_total)::DOUBLE AS revenue, {', '.join(f'count(*) - count({x}) AS without_{n}, round(100.0 * count({x}) / count(*)::DOUBLE, 4) AS {n}_coverage' for n, x in _COVER.items())}, round((sum(item_price_total) / nullif(count(item_price_total), 0))::DOUBLE, 4) AS aov
    FROM order_dates LEFT JOIN agg_order_items USING (order_id) LEFT JOIN agg_order_reviews USING (order_id) GROUP BY 1""")(lambda c: reliability(c))  # fmt: skip


def reliability(c):
    rows = c.order_dates.select("order_id", "month", "customer_delivery_timestamp").join(c.agg_order_items.select("order_id", "item_price_total"), "order_id", "left").join(c.agg_order_reviews.select("order_id", "latest_review_score"), "order_id", "left")
    parts = [x for n, v in _COVER.items() for x in ((F.count("*") - F.count(v)).alias(f"without_{n}"), F.round(100.0 * F.count(v) / F.count("*"), 4).alias(f"{n}_coverage"))]
    aov = F.round(F.try_divide(F.sum("item_price_total").cast("double"), F.count("item_price_total")), 4)
    return rows.groupBy("month").agg(F.count("*").alias("orders"), F.sum("item_price_total").alias("revenue"), *parts, aov.alias("aov"))


# B24
_VALUES = {"review_score": ("fact_reviews", "review_score"), "order_status": ("order_dates", "order_status"), "payment_type": ("fact_payments", "payment_type"), "customer_state": ("dim_customer", "customer_state"), "seller_state": ("dim_seller", "seller_state")}
_COUNTED = "SELECT '{n}' AS column, {x}::VARCHAR AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM {t})::DOUBLE, 6) AS share FROM {t} GROUP BY 2"
query("b24_value_counts", " UNION ALL ".join(_COUNTED.format(n=n, t=t, x=x) for n, (t, x) in _VALUES.items()))(
    lambda c: P.value_counts({n: ({"fact_reviews": c.fact_reviews, "order_dates": c.orders, "fact_payments": c.fact_payments, "dim_customer": c.dim_customer, "dim_seller": c.dim_seller}[t], x) for n, (t, x) in _VALUES.items()})
)
query("b24_top_categories", f"SELECT * FROM ({_COUNTED.format(n='category', t='dim_product', x='category_name_pt')}) ORDER BY n DESC, value NULLS FIRST LIMIT 20")(lambda c: P.value_counts({"category": (c.dim_product, "category_name_pt")}, 20))
_NUMBERS = ("item_count", "item_price_total", "item_freight_total")
query("b24_described", " UNION ALL ".join(f"SELECT '{x}' AS column, count({x}) AS count, round(avg({x}::DOUBLE), 6) AS mean, round(stddev({x}::DOUBLE), 6) AS std, min({x})::DOUBLE AS min, round(quantile_cont({x}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({x}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({x}::DOUBLE, 0.75), 6) AS p75, max({x})::DOUBLE AS max FROM agg_order_items" for x in _NUMBERS))(
    lambda c: P.described(c.agg_order_items, list(_NUMBERS))
)

# weeks, labelled by the Monday after them, with a calendar that has no gaps
query("f1_gap_filled_weeks", """WITH f AS (SELECT date_trunc('week', purchase_timestamp)::DATE + 7 AS d, count(*) AS orders, sum(item_price_total)::DOUBLE AS revenue FROM order_dates LEFT JOIN agg_order_items USING (order_id) WHERE order_status = 'delivered' GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d') AS period, coalesce(orders, 0) AS orders, revenue FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 7 DAY)) AS s FROM f) LEFT JOIN f ON d = s""")(lambda c: weekly(c))  # fmt: skip


def weekly(c):
    """Delivered orders and revenue of every week; weeks without orders have none and a revenue of null."""
    rows = c.orders.where("order_status = 'delivered'").join(c.agg_order_items.select("order_id", "item_price_total"), "order_id", "left")
    weeks = rows.groupBy(F.date_add(F.to_date(F.date_trunc("week", "purchase_timestamp")), 7).alias("d")).agg(F.count("*").alias("orders"), F.sum("item_price_total").alias("revenue"))
    calendar = weeks.agg(F.explode(F.sequence(F.min("d"), F.max("d"), F.expr("interval 7 days"))).alias("d"))
    return calendar.join(weeks, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("period"), F.coalesce("orders", F.lit(0)).alias("orders"), "revenue")


# F5, F7
query("f5_spike_by_state", f"SELECT customer_state, was, now, round(100.0 * (now - was) / greatest(was, 1)::DOUBLE, 4) AS growth_pct FROM (SELECT customer_state, count(*) FILTER (month = '{_WAS}') AS was, count(*) FILTER (month = '{_NOW}') AS now FROM fact_orders WHERE month IN ('{_WAS}', '{_NOW}') GROUP BY 1) ORDER BY growth_pct DESC, 1 LIMIT 10")(
    lambda c: _spike(K.Kpi(c, window=False).orders(["customer_state"]), "customer_state").withColumn("growth_pct", F.round(100.0 * (F.col("now") - F.col("was")) / F.greatest("was", F.lit(1)), 4)).orderBy(F.desc("growth_pct"), "customer_state").limit(10)
)
query("f5_spike_by_category", f"SELECT product_category, was, now, now - was AS growth FROM (SELECT coalesce(product_category, 'none') AS product_category, count(*) FILTER (month = '{_WAS}') AS was, count(*) FILTER (month = '{_NOW}') AS now FROM kpi_items WHERE month IN ('{_WAS}', '{_NOW}') GROUP BY 1) ORDER BY growth DESC, 1 LIMIT 10")(
    lambda c: _spike(K.Kpi(c, window=False).items(["product_category"]).withColumn("product_category", F.coalesce("product_category", F.lit("none"))), "product_category").withColumn("growth", F.col("now") - F.col("was")).orderBy(F.desc("growth"), "product_category").limit(10)
)


def _spike(rows, dim):
    return rows.where(F.col("month").isin(_WAS, _NOW)).groupBy(dim).agg(F.count_if(F.col("month") == _WAS).alias("was"), F.count_if(F.col("month") == _NOW).alias("now"))


query("f7_monthly_gmv", "SELECT month, sum(item_gmv_total)::DOUBLE AS gmv, count(*) AS orders, round((sum(item_gmv_total) / count(*))::DOUBLE, 4) AS aov, max(item_gmv_total)::DOUBLE AS largest, count(*) FILTER (item_gmv_total > 3 * m) AS extreme FROM (SELECT *, avg(item_gmv_total::DOUBLE) OVER (PARTITION BY month) AS m FROM order_dates JOIN agg_order_items USING (order_id) WHERE order_status = 'delivered') GROUP BY 1")(lambda c: gmv(c))


def gmv(c, times: float = 3.0):
    """GMV, orders, AOV and largest order of delivered orders by month, and how many orders are over three times its mean."""
    rows = c.orders.where("order_status = 'delivered'").join(c.agg_order_items.select("order_id", "item_gmv_total"), "order_id")
    by = rows.groupBy("month").agg(F.sum("item_gmv_total").alias("gmv"), F.count("*").alias("orders"), F.max("item_gmv_total").alias("largest"), F.avg(F.col("item_gmv_total").cast("double")).alias("m"))
    over = rows.join(by.select("month", "m"), "month").where(F.col("item_gmv_total") > times * F.col("m")).groupBy("month").agg(F.count("*").alias("extreme"))
    return by.join(over, "month", "left").select("month", "gmv", "orders", F.round(F.col("gmv").cast("double") / F.col("orders"), 4).alias("aov"), "largest", F.coalesce("extreme", F.lit(0)).alias("extreme"))
