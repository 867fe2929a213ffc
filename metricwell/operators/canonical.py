"""The canonical star schema: one-to-many tables are aggregated to order grain before any join."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import read_table, store

MONEY = "decimal(18,4)"


def resolve_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Left join to the translation; status TRANSLATED, UNTRANSLATED or NULL_CATEGORY. Never drops a row."""
    out = products.join(translation, "category_name_pt", "left")
    status = F.when(
        F.col("category_name_pt").isNull(),
        "NULL_CATEGORY",
    ).when(F.col("category_name_en").isNull(), "UNTRANSLATED").otherwise("TRANSLATED")
    return out.withColumn("category_resolution_status", status)


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, failing at the action if key is not unique."""
    counted = Window.partitionBy(*key)
    fine = F.assert_true(F.count("*").over(counted) == 1, F.lit(f"duplicate key {key}"))
    return df.withColumn("_ok", fine).where(F.col("_ok").isNull()).drop("_ok")


def aggregate_items(items: DataFrame) -> DataFrame:
    """Order-grain item measures."""
    return items.groupBy("order_id").agg(
        F.count("*").alias("item_count"),
        F.sum("price").cast(MONEY).alias("item_price_total"),
        F.sum("freight_value").cast(MONEY).alias("item_freight_total"),
        F.sum(F.col("price") + F.col("freight_value")).cast(MONEY).alias("item_gmv_total"),
        F.count_distinct("product_id").alias("distinct_product_count"),
        F.count_distinct("seller_id").alias("distinct_seller_count"),
    )


def aggregate_payments(payments: DataFrame) -> DataFrame:
    """Order-grain payment measures with the sorted distinct types."""
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").cast(MONEY).alias("total_payment_value"),
        F.count("*").alias("payment_count"),
        F.array_join(F.sort_array(F.collect_set("payment_type")), ",").alias("payment_types"),
        F.max("payment_installments").alias("max_installments"),
    )


def aggregate_reviews(reviews: DataFrame) -> DataFrame:
    """Order-grain review aggregates and the latest review (by answer time, then row id)."""
    latest = F.struct("review_answer_timestamp", "review_row_id")
    return reviews.groupBy("order_id").agg(
        F.count("*").alias("review_count"),
        F.round(F.avg("review_score"), 4).alias("avg_review_score"),
        F.min("review_score").alias("min_review_score"),
        F.max("review_score").alias("max_review_score"),
        F.max_by("review_score", latest).alias("latest_review_score"),
        F.max_by("review_id", latest).alias("latest_review_id"),
        F.bool_or("has_text").alias("has_review_text"),
        F.min("review_creation_date").alias("first_review_creation_date"),
        F.max("review_answer_timestamp").alias("last_review_answer_timestamp"),
    )


def _days(late: str, early: str) -> Column:
    return (F.unix_micros(F.col(late).cast("timestamp")) - F.unix_micros(F.col(early).cast("timestamp"))) / 86_400_000_000.0


def delivery_fields(orders: DataFrame) -> DataFrame:
    """Durations in days and the quality flag; the first rule that holds names the flag."""
    buy, carrier, got = (F.col(f"{c}_timestamp") for c in ("purchase", "carrier_delivery", "customer_delivery"))
    flag = (
        F.when((carrier < buy) | (got < carrier) | (got < buy), "INVALID_SEQUENCE")
        .when(got.isNull(), "MISSING_CUSTOMER_DATE")
        .when(carrier.isNull(), "MISSING_CARRIER_DATE")
        .otherwise("VALID")
    )
    return (
        orders.withColumn("delivery_days", _days("customer_delivery_timestamp", "purchase_timestamp"))
        .withColumn("carrier_days", _days("carrier_delivery_timestamp", "purchase_timestamp"))
        .withColumn("delivery_delay_days", _days("customer_delivery_timestamp", "estimated_delivery_timestamp"))
        .withColumn("delivery_data_quality_flag", flag)
    )


class Canonical:
    """The canonical tables over a folder of the given tables (the mapping of FIXTURES.md), each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.raw = spark, sf_dir, lambda name: read_table(spark, sf_dir, name)
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, build) -> DataFrame:
        """The table that build() gives, written on first use and read from then on: for what a query needs more than once."""
        if name not in self._stored:
            self._stored[name] = store(build())
        return self._stored[name]

    def has(self, name: str) -> bool:
        """Whether a table of this name is stored already."""
        return name in self._stored

    def only(self, keys: DataFrame) -> Canonical:
        """These tables with the orders and items of keys (order_id) alone, taken before anything is grouped or joined."""
        out, raw, key = Canonical(self.spark, self.sf_dir), self.raw, {"orders": "o_orderkey", "lineitem": "l_orderkey"}
        out.raw = lambda name: raw(name).join(keys.withColumnRenamed("order_id", key[name]), key[name], "left_semi") if name in key else raw(name)
        return out

    def kept(self, name: str, build):
        """What build() gives, made on first use: for what is not a table, as an index."""
        if name not in self._stored:
            self._stored[name] = build()
        return self._stored[name]

    @cached_property
    def dim_customer(self) -> DataFrame:
        people = self.raw("customer").join(F.broadcast(self.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        out = self.raw("orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        return out.selectExpr(
            "o_orderkey AS customer_id",
            "o_custkey AS customer_unique_id",
            "c_custkey % 50 AS customer_zip_code_prefix",
            "c_mktsegment AS customer_city",
            "n_name AS customer_state",
            "o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AS customer_identity_valid",
        )

    @cached_property
    def translation(self) -> DataFrame:
        return self.raw("part").where("p_type <> 'PROMO'").selectExpr("p_type AS category_name_pt", "lower(p_type) AS category_name_en").distinct()

    @cached_property
    def dim_product(self) -> DataFrame:
        products = self.raw("part").selectExpr(
            "p_partkey AS product_id",
            "CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS category_name_pt",
            "p_size AS product_size",
        )
        return resolve_products(products, self.translation)

    @cached_property
    def dim_seller(self) -> DataFrame:
        home = F.broadcast(self.raw("nation"))
        return self.raw("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"), "left").selectExpr(
            "s_suppkey AS seller_id",
            "s_suppkey % 50 AS seller_zip_code_prefix",
            "s_name AS seller_city",
            "n_name AS seller_state",
        )

    @cached_property
    def fact_order_items(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_extendedprice",
            "l_quantity",
            "l_shipdate",
            "l_discount",
            "l_tax",
        )
        return self.raw("lineitem").withColumn("order_item_id", F.row_number().over(order)).selectExpr(
            "l_orderkey AS order_id", "order_item_id", "l_partkey AS product_id", "l_suppkey AS seller_id", "l_shipdate AS shipping_limit_date",
            f"CAST(CAST(l_extendedprice AS decimal(12,2)) * (1 - CAST(l_discount AS decimal(4,2))) AS {MONEY}) AS price",
            f"CAST(CAST(l_extendedprice AS decimal(12,2)) * CAST(l_tax AS decimal(4,2)) AS {MONEY}) AS freight_value",
        )

    @cached_property
    def items(self) -> DataFrame:
        """fact_order_items without the item number, which needs a window."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id", "l_partkey AS product_id", "l_suppkey AS seller_id", "l_shipdate AS shipping_limit_date",
            f"CAST(CAST(l_extendedprice AS decimal(12,2)) * (1 - CAST(l_discount AS decimal(4,2))) AS {MONEY}) AS price",
            f"CAST(CAST(l_extendedprice AS decimal(12,2)) * CAST(l_tax AS decimal(4,2)) AS {MONEY}) AS freight_value",
        )

    @cached_property
    def agg_order_items(self) -> DataFrame:
        return aggregate_items(self.items)

    @cached_property
    def fact_payments(self) -> DataFrame:
        parts = self.agg_order_items.selectExpr("order_id", "item_gmv_total AS gmv", "1 + order_id % 3 AS k").withColumn(
            "payment_sequential",
            F.explode(F.expr("sequence(1, CAST(1 + order_id % 3 AS int))")),
        )
        value = "CAST(CASE WHEN payment_sequential < k THEN floor(gmv / k) ELSE gmv - (k - 1) * floor(gmv / k) END + CASE WHEN payment_sequential = k AND order_id % 250 = 0 THEN 5 ELSE 0 END AS decimal(18,4))"
        return parts.selectExpr(
            "order_id",
            "payment_sequential",
            "element_at(array('credit_card','voucher','boleto','debit_card'), CAST(1 + (order_id + payment_sequential) % 4 AS int)) AS payment_type",
            "1 + order_id % 12 AS payment_installments",
            f"{value} AS payment_value",
        )

    @cached_property
    def agg_order_payments(self) -> DataFrame:
        return aggregate_payments(self.fact_payments)

    @cached_property
    def fact_reviews(self) -> DataFrame:
        rows = self.raw("documents").join(self.raw("labels").select("doc_id", "quality"), "doc_id", "left").selectExpr(
            "doc_id AS review_row_id", "CASE WHEN doc_id % 20 < 2 THEN doc_id - doc_id % 2 ELSE doc_id END AS review_id",
            "CASE WHEN doc_id % 10 = 0 AND doc_id > 0 THEN doc_id - 1 ELSE doc_id END AS order_id",
            "CAST(1 + (doc_id * 3 + coalesce(quality, 1)) % 5 AS int) AS review_score", "text AS review_comment_message", "trim(coalesce(text, '')) <> '' AS has_text", "lang",
        )
        bought = self.raw("orders").selectExpr("o_orderkey AS order_id", "o_orderdate")
        dated = rows.join(bought, "order_id", "left")
        return dated.selectExpr(
            "* EXCEPT (o_orderdate)",
            "o_orderdate + make_dt_interval(10 + CAST(review_row_id % 20 AS int)) AS review_creation_date",
            "o_orderdate + make_dt_interval(13 + CAST(review_row_id % 20 AS int)) AS review_answer_timestamp",
        )

    @cached_property
    def agg_order_reviews(self) -> DataFrame:
        return aggregate_reviews(self.fact_reviews)

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with what needs no other table: ids, purchase, status and month."""
        status = "CASE WHEN o_orderkey % 97 = 0 THEN 'canceled' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'processing' END AS order_status"
        out = self.raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_orderkey AS customer_id",
            "o_custkey AS customer_unique_id",
            "o_orderdate AS purchase_timestamp",
            status,
        )
        return out.withColumn("month", F.date_format("purchase_timestamp", "yyyy-MM"))

    @cached_property
    def order_dates(self) -> DataFrame:
        """Orders with their five timestamps, status and delivery fields, without the existence flags."""
        ship = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min("l_shipdate").alias("ship"))
        out = self.orders.join(ship, "order_id", "left").selectExpr(
            "order_id", "customer_id", "customer_unique_id", "purchase_timestamp", "order_status",
            "purchase_timestamp + make_dt_interval(CAST(pmod(datediff(ship, purchase_timestamp), 15) - 1 AS int)) AS carrier_delivery_timestamp",
            "purchase_timestamp + make_dt_interval(20) AS estimated_delivery_timestamp",
        )
        got = F.expr("CASE WHEN order_id % 33 <> 0 THEN carrier_delivery_timestamp + make_dt_interval(CAST(order_id % 25 AS int)) END")
        return delivery_fields(out.withColumn("customer_delivery_timestamp", got)).withColumn("month", F.date_format("purchase_timestamp", "yyyy-MM"))

    @cached_property
    def window(self) -> DataFrame:
        """One row: first and last month whose orders are a tenth of the median month's or more; counted once, then stored."""
        return self.stored("window", self._window)

    def _window(self) -> DataFrame:
        months = self.orders.groupBy("month").agg(F.count("*").alias("n"))
        limit = months.agg(F.median("n").alias("m"))
        return months.crossJoin(F.broadcast(limit)).where("n >= 0.1 * m").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))

    @cached_property
    def fact_orders(self) -> DataFrame:
        has = lambda df, name: df.select("order_id").distinct().withColumn(name, F.lit(True))
        out = self.order_dates.join(self.dim_customer.select("customer_id", "customer_state", "customer_city"), "customer_id", "left")
        for df, name in ((self.items, "has_items"), (self.agg_order_items, "has_payment"), (self.raw_reviews, "has_review")):
            out = out.join(has(df, name), "order_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        out = out.withColumn("has_delivery_data", F.col("customer_delivery_timestamp").isNotNull())
        return out.crossJoin(F.broadcast(self.window)).withColumn(
            "in_analytical_window",
            F.col("month").between(F.col("first_month"), F.col("last_month")),
        ).drop("first_month", "last_month")

    @cached_property
    def raw_reviews(self) -> DataFrame:
        """Keys of fact_reviews alone."""
        return self.raw("documents").selectExpr("CASE WHEN doc_id % 10 = 0 AND doc_id > 0 THEN doc_id - 1 ELSE doc_id END AS order_id")

    def in_window(self, orders: DataFrame) -> DataFrame:
        """orders with in_analytical_window."""
        flag = F.col("month").between(F.col("first_month"), F.col("last_month"))
        return orders.crossJoin(F.broadcast(self.window)).withColumn("in_analytical_window", flag).drop("first_month", "last_month")

    @cached_property
    def scoped_orders(self) -> DataFrame:
        """orders with the window flag: what most KPIs need of an order."""
        return self.in_window(self.orders)
