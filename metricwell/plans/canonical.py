"""Queries of groups A to E: canonical tables, filters, joins and KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as K
from ..sources import tables as S
from .sql import Registry

query = Registry()
_TABLES = ("customer", "orders", "lineitem", "part", "supplier", "events")
query("a2_scan_orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")(
    lambda c: c.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
)
query(
    "a4_row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES),
)(lambda c: S.row_counts({t: c.raw(t) for t in _TABLES}))
_MONEY = {
    "fact_order_items": "price freight_value",
    "fact_payments": "payment_value",
    "agg_order_items": "item_price_total item_freight_total item_gmv_total",
    "agg_order_payments": "total_payment_value",
}
for _name, _table in (("a5_dim_customer", "dim_customer"), ("a6_dim_product", "dim_product"), ("a7_dim_seller", "dim_seller"), ("a8_fact_order_items", "fact_order_items"), ("a8_fact_payments", "fact_payments"), ("a10_agg_order_items", "agg_order_items"), ("a11_agg_order_payments", "agg_order_payments"), ("a12_agg_order_reviews", "agg_order_reviews"), ("a14_fact_orders", "fact_orders")):
    query(_name, f"SELECT * FROM {_table}", _MONEY.get(_table, ""))(lambda c, t=_table: getattr(c, t))
query(
    "a9_fact_reviews",
    "SELECT review_row_id, review_id, order_id, review_score, has_text, lang, review_creation_date, review_answer_timestamp FROM fact_reviews",
)(lambda c: c.fact_reviews.drop("review_comment_message"))
query(
    "a13_delivery_fields",
    "SELECT order_id, delivery_days, carrier_days, delivery_delay_days, delivery_data_quality_flag FROM order_dates",
)(lambda c: c.order_dates.select("order_id", "delivery_days", "carrier_days", "delivery_delay_days", "delivery_data_quality_flag"))


@query("a15_build_summary", """SELECT 'flag=' || delivery_data_quality_flag AS item, count(*) AS n FROM order_dates GROUP BY 1 UNION ALL
    SELECT 'orders', count(*) FROM order_dates UNION ALL SELECT 'items', count(*) FROM fact_order_items UNION ALL SELECT 'payments', count(*) FROM fact_payments UNION ALL
    SELECT 'in_window', count(*) FROM order_dates, win WHERE month BETWEEN first_month AND last_month""")
def _summary(c):
    flags = c.order_dates.groupBy(F.concat(F.lit("flag="), "delivery_data_quality_flag").alias("item")).agg(F.count("*").alias("n"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return flags.union(one(c.order_dates, "orders")).union(one(c.items, "items")).union(one(c.fact_payments, "payments")).union(
        one(c.scoped_orders.where("in_analytical_window"), "in_window")
    )


_GEO = "SELECT c_custkey % 50 AS prefix, c_acctbal / 1000 AS lat, c_nationkey::DOUBLE AS lng, c_mktsegment AS city, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _geo(c):
    return c.raw("customer").join(F.broadcast(c.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey % 50 AS prefix",
        "c_acctbal / 1000 AS lat",
        "CAST(c_nationkey AS double) AS lng",
        "c_mktsegment AS city",
        "n_name AS state",
    )


@query("a16_geolocation", f"""WITH g AS ({_GEO}),
    m AS (SELECT prefix, first(city ORDER BY n DESC, city) AS city FROM (SELECT prefix, city, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT prefix, first(state ORDER BY n DESC, state) AS state FROM (SELECT prefix, state, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT prefix, round(median(lat), 6) AS lat, round(median(lng), 6) AS lng, any_value(m.city) AS city, any_value(s.state) AS state, count(*) AS source_row_count,
    count(DISTINCT g.city) > 1 OR count(DISTINCT g.state) > 1 AS is_ambiguous FROM g JOIN m USING (prefix) JOIN s USING (prefix) GROUP BY prefix""")
def _geolocation(c):
    g = _geo(c)
    mode = lambda col: g.groupBy("prefix", col).agg(F.count("*").alias("n")).groupBy("prefix").agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias(col))
    out = g.groupBy("prefix").agg(
        F.round(F.median("lat"), 6).alias("lat"),
        F.round(F.median("lng"), 6).alias("lng"),
        F.count("*").alias("source_row_count"),
        ((F.count_distinct("city") > 1) | (F.count_distinct("state") > 1)).alias("is_ambiguous"),
    )
    return out.join(mode("city"), "prefix").join(mode("state"), "prefix")


@query("a17_ambiguity_report", f"WITH g AS ({_GEO}) SELECT prefix, array_to_string(list_sort(list(DISTINCT city)), ',') AS cities, array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM g GROUP BY 1 HAVING count(DISTINCT city) > 1 OR count(DISTINCT state) > 1")
def _ambiguity(c):
    out = _geo(c).groupBy("prefix").agg(F.sort_array(F.collect_set("city")).alias("a"), F.sort_array(F.collect_set("state")).alias("b"))
    return out.where((F.size("a") > 1) | (F.size("b") > 1)).select(
        "prefix",
        F.array_join("a", ",").alias("cities"),
        F.array_join("b", ",").alias("states"),
    )


@query("a19_geolocation_checks", f"WITH g AS ({_GEO}), p AS (SELECT prefix, median(lat) AS lat, median(lng) AS lng FROM g GROUP BY 1) SELECT count(*) = count(DISTINCT prefix) AS unique_key, count(*) = (SELECT count(DISTINCT prefix) FROM g) AS all_prefixes, count(*) FILTER (prefix IS NULL OR lat IS NULL OR lng IS NULL) = 0 AS no_nulls FROM p")
def _geo_checks(c):
    g = _geo(c)
    p = g.groupBy("prefix").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    n = g.agg(F.count_distinct("prefix").alias("n"))
    return p.crossJoin(F.broadcast(n)).agg(
        (F.count("*") == F.count_distinct("prefix")).alias("unique_key"),
        (F.count("*") == F.max("n")).alias("all_prefixes"),
        (F.count_if(F.col("prefix").isNull() | F.col("lat").isNull() | F.col("lng").isNull()) == 0).alias("no_nulls"),
    )


@query("a20_category_enrichment", """SELECT product_id, CASE WHEN category_name_en IS NOT NULL THEN category_name_en WHEN category_name_pt = 'PROMO' THEN 'promotional' WHEN category_name_pt IS NULL THEN 'Uncategorized' END AS category,
    CASE WHEN category_name_en IS NOT NULL THEN 'official' WHEN category_name_pt = 'PROMO' THEN 'override' WHEN category_name_pt IS NULL THEN 'null_default' ELSE 'unresolved' END AS category_source FROM dim_product""")
def _enriched(c):
    override = c.spark.createDataFrame([("PROMO", "promotional")], "category_name_pt string, other string")
    out = c.dim_product.join(F.broadcast(override), "category_name_pt", "left")
    none = F.col("category_name_pt").isNull()
    source = F.when(
        F.col("category_name_en").isNotNull(),
        "official",
    ).when(F.col("other").isNotNull(), "override").when(none, "null_default").otherwise("unresolved")
    return out.select(
        "product_id",
        F.coalesce("category_name_en", "other", F.when(none, "Uncategorized")).alias("category"),
        source.alias("category_source"),
    )


@query("a21_category_coverage", "SELECT count(*) AS products, count(category_name_pt) AS with_category, count(category_name_en) AS translated, round(count(category_name_en) / nullif(count(category_name_pt), 0)::DOUBLE, 4) AS coverage FROM dim_product")
def _coverage(c):
    return c.dim_product.agg(
        F.count("*").alias("products"),
        F.count("category_name_pt").alias("with_category"),
        F.count("category_name_en").alias("translated"),
        F.round(F.try_divide(F.count("category_name_en"), F.count("category_name_pt")), 4).alias("coverage"),
    )


def of_reviews(c, rows, key="order_id"):
    """The rows of orders that have a review, before anything is joined or grouped; the keys are written once, so that their size is known."""
    keys = c.stored("review orders", lambda: c.raw_reviews.where("order_id IS NOT NULL").distinct())
    return rows.join(keys.withColumnRenamed("order_id", key), key, "left_semi")


def attribution(c):
    """One row per review with the method by which it is tied to a product or category; seller_id is -1 where it is not tied."""
    rows = of_reviews(c, c.items).join(
        c.dim_product.selectExpr("product_id", "coalesce(category_name_en, category_name_pt, 'uncategorized') AS category"),
        "product_id",
        "left",
    )
    per = rows.groupBy("order_id").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set("category")).alias("cats"),
        F.sort_array(F.collect_set("seller_id")).alias("sellers"),
    )
    out = c.fact_reviews.select("review_row_id", "order_id").join(per, "order_id", "left")
    method = F.when(F.col("n").isNull(), "no_items_on_order").when(F.col("n") == 1, "single_item_order").when(
        (F.size("cats") == 1) & (F.size("sellers") == 1),
        "single_category_order",
    ).otherwise("multi_item_order_ambiguous")
    out = out.withColumn("attribution_method", method)
    sure = F.col("attribution_method").isin("single_item_order", "single_category_order")
    return out.select(
        "review_row_id",
        "order_id",
        "attribution_method",
        F.when(sure, F.get("cats", F.lit(0))).alias("category"),
        F.coalesce(F.when(sure, F.get("sellers", F.lit(0))), F.lit(-1)).alias("seller_id"),
    )


_ATTR = """WITH per AS (SELECT order_id, count(*) AS n, list_sort(list(DISTINCT coalesce(category_name_en, category_name_pt, 'uncategorized'))) AS cats, list_sort(list(DISTINCT seller_id)) AS sellers
    FROM fact_order_items JOIN dim_product USING (product_id) GROUP BY 1),
    att AS (SELECT review_row_id, order_id, CASE WHEN n IS NULL THEN 'no_items_on_order' WHEN n = 1 THEN 'single_item_order' WHEN len(cats) = 1 AND len(sellers) = 1 THEN 'single_category_order' ELSE 'multi_item_order_ambiguous' END AS attribution_method,
    CASE WHEN n = 1 OR len(cats) = 1 AND len(sellers) = 1 THEN cats[1] END AS category, CASE WHEN n = 1 OR len(cats) = 1 AND len(sellers) = 1 THEN sellers[1] ELSE -1 END AS seller_id FROM fact_reviews LEFT JOIN per USING (order_id))"""
query("a22_review_attribution", f"{_ATTR} SELECT * FROM att")(attribution)
query("a23_entity_linkage", f"{_ATTR} SELECT count(*) AS reviews, count(category) AS linked, round(count(category) / count(*)::DOUBLE, 6) AS share FROM att")(
    lambda c: attribution(c).agg(
        F.count("*").alias("reviews"),
        F.count("category").alias("linked"),
        F.round(F.try_divide(F.count("category"), F.count("*")), 6).alias("share"),
    )
)

# C: filters and time
query(
    "c1_date_range",
    "SELECT order_id FROM order_dates WHERE purchase_timestamp >= DATE '2001-05-01' AND purchase_timestamp < DATE '2001-06-01'",
)(lambda c: c.order_dates.where(K.in_range("purchase_timestamp", "2001-05-01", "2001-05-31")).select("order_id"))
query(
    "c2_window_filter",
    "SELECT order_id FROM order_dates, win WHERE month BETWEEN first_month AND last_month",
)(lambda c: c.scoped_orders.where("in_analytical_window").select("order_id"))
query(
    "c3_status_filter",
    "SELECT order_id FROM order_dates WHERE order_status IN ('delivered', 'shipped')",
)(lambda c: c.order_dates.where(F.col("order_status").isin("delivered", "shipped")).select("order_id"))
query(
    "c4_delivery_flag_filter",
    "SELECT order_id FROM order_dates WHERE delivery_data_quality_flag = 'VALID'",
)(lambda c: c.order_dates.where("delivery_data_quality_flag = 'VALID'").select("order_id"))
query("c5_time_buckets", """SELECT order_id, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%Y-%m') AS month, strftime(e - 6, '%Y-%m-%d') || '/' || strftime(e, '%Y-%m-%d') AS week
    FROM (SELECT order_id, purchase_timestamp::DATE AS d, purchase_timestamp::DATE + ((8 - isodow(purchase_timestamp)) % 7)::INTEGER AS e FROM order_dates)""")(lambda c: c.order_dates.select("order_id", *(K.bucket(F.col("purchase_timestamp"), g).alias(g) for g in ("day", "month", "week"))))
query(
    "c7_quality_tier",
    "SELECT order_id, CASE WHEN x >= 95 THEN 'HIGH' WHEN x >= 80 THEN 'MEDIUM' ELSE 'LOW' END AS tier "
    "FROM (SELECT order_id, (order_id % 101)::DOUBLE AS x FROM order_dates)",
)(lambda c: c.order_dates.select("order_id", K.quality_tier((F.col("order_id") % 101).cast("double")).alias("tier")))
query(
    "c8_coverage_warning",
    "SELECT order_id, CASE "
    "WHEN x < 95 AND order_id % 7 > 0 THEN printf('coverage %.1f%% below 95.0%% (%d excluded)', x, order_id % 7) END AS warning "
    "FROM (SELECT order_id, (order_id % 101)::DOUBLE AS x FROM order_dates)",
)(lambda c: c.order_dates.select("order_id", K.coverage_warning((F.col("order_id") % 101).cast("double"), F.col("order_id") % 7).alias("warning")))
query("c9_month_bounds", "SELECT DISTINCT month, strftime(date_trunc('month', purchase_timestamp), '%Y-%m-%d') AS first_day, strftime(last_day(purchase_timestamp), '%Y-%m-%d') AS last_day, strftime(date_trunc('month', purchase_timestamp) - INTERVAL 1 MONTH, '%Y-%m') AS previous FROM order_dates")(
    lambda c: c.order_dates.select(
        "month",
        F.date_format(F.trunc("purchase_timestamp", "month"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.last_day("purchase_timestamp"), "yyyy-MM-dd").alias("last_day"),
        F.date_format(F.add_months(F.trunc("purchase_timestamp", "month"), -1), "yyyy-MM").alias("previous"),
    ).distinct()
)

# D: joins
query("d1_items_in_context", "SELECT order_id, product_id, price, order_status, month FROM fact_order_items JOIN order_dates USING (order_id)", "price")(
    lambda c: c.items.join(
        c.order_dates.select("order_id", "order_status", "month"),
        "order_id",
    ).select("order_id", "product_id", "price", "order_status", "month")
)
query(
    "d2_left_dimensions",
    "SELECT order_id, product_id, seller_id, category_name_en, seller_state FROM fact_order_items LEFT "
    "JOIN dim_product USING (product_id) LEFT JOIN dim_seller USING (seller_id)",
)(
    lambda c: c.items.join(c.dim_product, "product_id", "left").join(c.dim_seller, "seller_id", "left").select(
        "order_id",
        "product_id",
        "seller_id",
        "category_name_en",
        "seller_state",
    )
)
query(
    "d5_full_outer_reconciliation",
    "SELECT coalesce(i.order_id, p.order_id) AS order_id, item_gmv_total, total_payment_value, total_payment_value - item_gmv_total AS diff "
    "FROM agg_order_items i FULL JOIN agg_order_payments p ON i.order_id = p.order_id",
    "item_gmv_total total_payment_value diff",
)(
    lambda c: c.agg_order_items.join(c.agg_order_payments, "order_id", "full_outer").select(
        "order_id",
        "item_gmv_total",
        "total_payment_value",
        (F.col("total_payment_value") - F.col("item_gmv_total")).alias("diff"),
    )
)
query("d6_existence_flags", "SELECT order_id, order_id IN (SELECT order_id FROM fact_reviews) AS has_review FROM order_dates")(
    lambda c: c.order_dates.select("order_id").join(
        c.raw_reviews.distinct().withColumn("has_review", F.lit(True)),
        "order_id",
        "left",
    ).withColumn("has_review", F.coalesce("has_review", F.lit(False)))
)
query(
    "d7_orders_without_items",
    "SELECT order_id FROM order_dates WHERE order_id NOT IN (SELECT order_id FROM fact_order_items)",
)(lambda c: c.order_dates.select("order_id").join(c.items, "order_id", "left_anti"))
query(
    "d8_fanout_join",
    "SELECT count(*) AS n, sum(price)::DECIMAL(38,4) AS revenue FROM fact_order_items JOIN fact_payments USING (order_id)",
    "revenue",
)(lambda c: c.items.join(c.fact_payments, "order_id").agg(F.count("*").alias("n"), F.sum("price").cast("decimal(38,4)").alias("revenue")))
query(
    "d10_scalar_join",
    "SELECT month, n, n >= 0.1 * m AS reliable FROM (SELECT month, count(*) AS n FROM order_dates GROUP BY 1), (SELECT median(n) AS m "
    "FROM (SELECT count(*) AS n FROM order_dates GROUP BY month))",
)(
    lambda c: (
        m := c.order_dates.groupBy("month").agg(F.count("*").alias("n"))
    ).crossJoin(F.broadcast(m.agg(F.median("n").alias("m")))).select("month", "n", (F.col("n") >= 0.1 * F.col("m")).alias("reliable"))
)

# E: KPIs, by month and one dimension
_W = "in_analytical_window"
_TIER = "CASE WHEN coverage IS NULL THEN 'UNKNOWN' WHEN coverage >= 95 THEN 'HIGH' WHEN coverage >= 80 THEN 'MEDIUM' ELSE 'LOW' END AS data_quality"
_REACH = f"(SELECT 100.0 * count(*) FILTER (has_items) / nullif(count(*), 0)::DOUBLE FROM fact_orders WHERE {_W})"
_VALID = "delivery_data_quality_flag = 'VALID'"


def _kpi(name: str, kpi: str, dims: list[str], sql: str) -> None:
    query(name, f"SELECT *, {_TIER} FROM ({sql})")(
        lambda c: K.Kpi(c).compute(kpi, dims).withColumn(
            "value",
            F.round(F.col("value").cast("double"), 4),
        ).withColumn("coverage", F.round("coverage", 6))
    )


for _n, _k, _col in (("e1_revenue", "revenue", "price"), ("e2_freight_revenue", "freight_revenue", "freight_value")):
    for _suffix, _dims in (("", []), ("_by_month_category", ["month", "product_category"]), ("_by_seller_state", ["seller_state"])):
        _d = ", ".join(_dims)
        _kpi(
            _n + _suffix,
            _k,
            _dims,
            f"SELECT {_d}{',' if _d else ''} round(sum({_col})::DOUBLE, 4) AS value, count(*) AS sample_size, round({_REACH}, 6) AS coverage "
            f"FROM kpi_items WHERE {_W} {'GROUP BY ' + _d if _d else ''}",
        )
_kpi(
    "e3_quantity_by_month",
    "quantity_sold",
    ["month"],
    f"SELECT month, count(*)::DOUBLE AS value, count(*) AS sample_size, 100.0::DOUBLE AS coverage FROM kpi_items WHERE {_W} GROUP BY 1",
)
_kpi(
    "e4_orders_by_status",
    "orders",
    ["order_status"],
    "SELECT order_status, count(DISTINCT order_id)::DOUBLE AS value, count(*) AS sample_size, 100.0::DOUBLE AS coverage FROM fact_orders "
    f"WHERE {_W} GROUP BY 1",
)
_kpi(
    "e5_aov",
    "aov",
    [],
    "SELECT round(sum(item_price_total)::DOUBLE / count(item_price_total), 4) AS value, count(item_price_total) AS sample_size, round(100.0 * count(item_price_total) / count(*)::DOUBLE, 6) AS coverage " f"FROM fact_orders LEFT JOIN agg_order_items USING (order_id) WHERE {_W}",
)
_kpi(
    "e5_aov_by_state",
    "aov",
    ["customer_state"],
    "SELECT customer_state, round(sum(item_price_total)::DOUBLE / count(item_price_total), 4) AS value, count(item_price_total) AS sample_size, NULL::DOUBLE AS coverage " f"FROM fact_orders LEFT JOIN agg_order_items USING (order_id) WHERE {_W} GROUP BY 1",
)
_kpi(
    "e6_delivery_days_by_month",
    "avg_delivery_days",
    ["month"],
    "SELECT month, round(avg(CASE " f"WHEN {_VALID} THEN delivery_days END), 4) AS value, count(*) FILTER ({_VALID}) AS sample_size, round(100.0 * count(*) FILTER ({_VALID}) / count(*)::DOUBLE, 6) AS coverage " f"FROM fact_orders WHERE {_W} GROUP BY 1",
)
_kpi(
    "e7_on_time_by_state",
    "on_time_delivery_rate",
    ["customer_state"],
    f"SELECT customer_state, round(count(*) FILTER ({_VALID} AND delivery_delay_days <= 0) / nullif(count(*) FILTER ({_VALID}), 0)::DOUBLE, 4) AS value, count(*) FILTER ({_VALID}) AS sample_size, round(100.0 * count(*) FILTER ({_VALID}) / count(*)::DOUBLE, 6) AS coverage " f"FROM fact_orders WHERE {_W} GROUP BY 1",
)
_kpi(
    "e8_review_score_by_month",
    "avg_review_score",
    ["month"],
    "SELECT month, round(avg(latest_review_score), 4) AS value, count(latest_review_score) AS sample_size, NULL::DOUBLE AS coverage "
    f"FROM fact_orders LEFT JOIN agg_order_reviews USING (order_id) WHERE {_W} GROUP BY 1",
)
_kpi(
    "e9_review_volume_by_month",
    "review_volume",
    ["month"],
    "SELECT strftime(review_creation_date, '%Y-%m') AS month, count(*)::DOUBLE AS value, count(*) AS sample_size, 100.0::DOUBLE AS coverage "
    f"FROM fact_reviews JOIN (SELECT order_id, {_W} FROM fact_orders) USING (order_id) WHERE {_W} GROUP BY 1",
)
_kpi(
    "e10_repeat_purchase_rate",
    "repeat_purchase_rate",
    [],
    "SELECT round(count(*) FILTER (n >= 2) / count(*)::DOUBLE, 4) AS value, count(*) AS sample_size, 100.0::DOUBLE AS coverage "
    "FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM fact_orders GROUP BY 1)",
)
query("e12_period_over_period", """SELECT product_category, previous, current, round(current::DOUBLE - previous::DOUBLE, 4) AS absolute_change, round(100 * (current::DOUBLE - previous::DOUBLE) / nullif(abs(previous::DOUBLE), 0), 6) AS percent_change FROM (
    SELECT product_category, sum(CASE WHEN month = '2001-05' THEN price END)::DECIMAL(18,4) AS previous, sum(CASE WHEN month = '2001-06' THEN price END)::DECIMAL(18,4) AS current FROM kpi_items WHERE month IN ('2001-05', '2001-06') GROUP BY 1)""", "previous current")(lambda c: K.compare_periods(c, "2001-06", "2001-05"))
query("e15_grouping_sets", f"SELECT month, product_category, seller_state, grouping_id(month, product_category, seller_state) AS slice, sum(price)::DECIMAL(18,4) AS revenue, count(*) AS n FROM kpi_items WHERE {_W} GROUP BY GROUPING SETS ((month, product_category), (month, seller_state), (month), ())", "revenue")(
    lambda c: K.Kpi(c).items(["product_category", "seller_state"]).groupingSets(
        [["month", "product_category"], ["month", "seller_state"], ["month"], []],
        "month",
        "product_category",
        "seller_state",
    ).agg(F.grouping_id().alias("slice"), F.sum("price").cast("decimal(18,4)").alias("revenue"), F.count("*").alias("n"))
)
