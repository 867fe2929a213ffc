"""KPI contracts as nested rows, and the rules on them as joins against what is allowed.

A contract: contract_id, kpi, aggregation, has_ratio, base_grain, source_tables and source_columns (arrays), dimensions
(name, source_table, supported, unsupported_reason), filters (source_column, applied_by_default), variants (variant_id,
is_default), drivers (driver_name, is_causal_claim), materiality_implemented, review_governance_reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the rules require of contracts.
RATIOS = ("RATIO", "DERIVED_RATIO")
TABLES = (
    "dim_customer", "dim_product", "dim_seller", "dim_geolocation", "fact_orders", "fact_order_items", "fact_payments",
    "fact_reviews", "agg_order_items", "agg_order_payments", "agg_order_reviews",
)
DELIVERY = ("avg_delivery_days", "on_time_delivery_rate")
DELIVERY_FLAG = "fact_orders.delivery_data_quality_flag"
REVIEW_VARIANTS = ("order_level_representative", "review_level_average")
REVENUE = ("order_items.price", "item_price_total")


def contract_rules(contracts: DataFrame, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """(contract_id, rule, subject) of every broken rule; subject names the table, dimension or driver, or is the KPI.

    Rules: unknown_table and unknown_dimension_table (anti joins against the tables there are), no_unsupported_reason,
    ratio_missing, not_one_default, duplicate_contract, revenue_source, revenue_from_payments, repeat_customer,
    repeat_grain, delivery_filter, review_reference, review_variants, causal_driver, materiality. Null arrays are empty.
    """
    known = contracts.sparkSession.createDataFrame([(t,) for t in tables], "t string")
    each = lambda c: contracts.select("contract_id", "kpi", F.explode(c).alias("x"))
    out = lambda df, rule, subject="kpi": df.select("contract_id", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    absent = lambda df, column: df.join(F.broadcast(known), F.col(column) == F.col("t"), "left_anti")
    some = lambda array, test: F.coalesce(F.exists(array, test), F.lit(False))
    named = lambda *texts: some("source_columns", lambda c: reduce(lambda a, b: a | b, (c.contains(t) for t in texts)))
    defaults = F.size(F.filter("variants", lambda v: F.coalesce(v["is_default"], F.lit(False))))
    variant = lambda name: some("variants", lambda v: v["variant_id"] == name)
    of = lambda *kpis: F.col("kpi").isin(*kpis)
    flagged = some("filters", lambda f: (f["source_column"] == DELIVERY_FLAG) & f["applied_by_default"])
    plain = {
        "ratio_missing": F.col("aggregation").isin(*RATIOS) & ~F.coalesce("has_ratio", F.lit(False)),
        "not_one_default": (F.size("variants") > 0) & (defaults != 1),
        "revenue_source": of("revenue") & ~named(*REVENUE),
        "revenue_from_payments": of("revenue") & named("payment_value"),
        "repeat_customer": of("repeat_purchase_rate") & ~named("customer_unique_id"),
        "repeat_grain": of("repeat_purchase_rate") & ~F.coalesce(F.lower(F.split("base_grain", " ")[0]) == "customer_unique_id", F.lit(False)),
        "delivery_filter": of(*DELIVERY) & ~flagged,
        "review_reference": of("avg_review_score") & F.col("review_governance_reference").isNull(),
        "review_variants": of("avg_review_score") & ~reduce(lambda a, b: a & b, map(variant, REVIEW_VARIANTS)),
        "materiality": ~F.coalesce(F.col("materiality_implemented") == F.lit(False), F.lit(False)),
    }
    single = F.array_compact(F.array(*(F.when(test, rule) for rule, test in plain.items())))
    repeated = contracts.groupBy("contract_id").agg(F.count("*").alias("n"), F.max("kpi").alias("kpi")).where("n > 1")
    parts = [
        contracts.select("contract_id", F.explode(single).alias("rule"), F.col("kpi").alias("subject")),
        out(repeated, "duplicate_contract"),
        out(absent(each("source_tables"), "x"), "unknown_table", "x"),
        out(absent(each("dimensions"), "x.source_table").select("contract_id", "x.name"), "unknown_dimension_table", "name"),
        out(each("dimensions").where("NOT x.supported AND x.unsupported_reason IS NULL").select("contract_id", "x.name"), "no_unsupported_reason", "name"),
        out(each("drivers").where("coalesce(x.is_causal_claim, true)").select("contract_id", "x.driver_name"), "causal_driver", "driver_name"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
