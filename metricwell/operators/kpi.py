"""The governed KPIs: total or grouped, with sample size, coverage and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import MONEY, Canonical

#: Contract values: coverage threshold in percent, absolute and relative materiality thresholds, least sample.
COVERAGE_THRESHOLD = 95.0
KPIS = (
    "revenue",
    "freight_revenue",
    "quantity_sold",
    "orders",
    "aov",
    "avg_delivery_days",
    "on_time_delivery_rate",
    "avg_review_score",
    "review_volume",
    "repeat_purchase_rate",
)
DIMENSIONS = ("day", "week", "month", "product_category", "product", "customer_state", "seller_state", "seller", "order_status")
ITEM_DIMENSIONS = ("product_category", "product", "seller_state", "seller")
REVIEW_VARIANTS = ("order_level_representative", "order_level_true_average", "review_level_average")
#: Customers below which a repeat purchase rate is not stable.
MINIMUM_OBSERVATIONS = 30
CLEARANCE = {"PUBLIC_ANALYTICAL": 0, "INTERNAL": 1, "RESTRICTED": 2}
DIMENSION_CLEARANCE = {"seller_state": "INTERNAL", "seller": "INTERNAL"}


def bucket(ts: Column, grain: str) -> Column:
    """Day, week or month label. A week is "start/end" and ends on Monday."""
    if grain == "month":
        return F.date_format(ts, "yyyy-MM")
    if grain == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if grain == "week":
        end = F.next_day(F.date_sub(ts.cast("date"), 1), "MON")
        return F.concat_ws("/", F.date_sub(end, 6).cast("string"), end.cast("string"))
    raise ValueError(f"unknown grain {grain!r}")


def quality_tier(coverage: Column, threshold: float = COVERAGE_THRESHOLD) -> Column:
    """HIGH, MEDIUM (within 15 points), LOW, or UNKNOWN without a coverage."""
    return F.when(coverage.isNull(), "UNKNOWN").when(coverage >= threshold, "HIGH").when(
        coverage >= max(threshold - 15, 0),
        "MEDIUM",
    ).otherwise("LOW")


def coverage_warning(coverage: Column, excluded: Column, threshold: float = COVERAGE_THRESHOLD) -> Column:
    """A warning where coverage is below its threshold and something was left out, else null."""
    return F.when(
        (coverage < threshold) & (excluded > 0),
        F.format_string("coverage %.1f%% below %.1f%% (%d excluded)", coverage, F.lit(threshold), excluded),
    )


def in_range(ts: str, start: str | None, end: str | None) -> Column:
    """Whole days from start to end, both included."""
    out = F.lit(True)
    if (start is None) != (end is None):
        raise ValueError("give both dates or neither")
    if start:
        out = (F.col(ts) >= F.lit(start).cast("date")) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1))
    return out


def in_default_range(tables: Canonical, rows: DataFrame, ts: str = "purchase_timestamp") -> DataFrame:
    """rows of the reliable months, the range where none is given, with its first_day and last_day."""
    first, last = F.to_date(F.concat("first_month", F.lit("-01"))), F.last_day(F.to_date(F.concat("last_month", F.lit("-01"))))
    out = rows.crossJoin(F.broadcast(tables.window.select(first.alias("first_day"), last.alias("last_day"))))
    out = out.where((F.col(ts) >= F.col("first_day")) & (F.col(ts) < F.date_add("last_day", 1)))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


def check_dimensions(kpi: str, dims: list[str], clearance: str = "RESTRICTED") -> None:
    """Rejects unknown or unsupported dimensions and those above the caller's clearance."""
    if kpi not in KPIS:
        raise ValueError(f"unknown KPI {kpi!r}")
    for d in dims:
        if d not in DIMENSIONS or (kpi == "repeat_purchase_rate") or (kpi in ("orders", "aov", "avg_delivery_days", "on_time_delivery_rate", "avg_review_score", "review_volume") and d in ITEM_DIMENSIONS):
            raise ValueError(f"dimension {d!r} is not supported by {kpi}")
        if CLEARANCE[DIMENSION_CLEARANCE.get(d, "PUBLIC_ANALYTICAL")] > CLEARANCE[clearance]:
            raise PermissionError(f"dimension {d!r} needs {DIMENSION_CLEARANCE[d]} clearance")


class Kpi:
    """KPIs over a Canonical, for one range of days, statuses and window setting."""

    def __init__(self, tables: Canonical, start: str | None = None, end: str | None = None, statuses: tuple[str, ...] | None = None, window: bool = True, clearance: str = "RESTRICTED"):
        self.t, self.clearance = tables, clearance
        self.window, self.start, self.end, self.statuses = window, start, end, statuses

    def orders(self, dims: list[str] = [], window: bool | None = None, statuses: tuple[str, ...] | None = None, dated: bool = True, delivery: bool = False) -> DataFrame:  # noqa: B006
        """Orders in scope with the columns that dims need.

        dated: whether the range of days is that of the purchase; delivery: whether durations and flags are needed,
        which come from another table.
        """
        out = self.t.order_dates if delivery else self.t.orders
        if self.window if window is None else window:
            out = self.t.in_window(out)
        if dated:
            out = out.where(in_range("purchase_timestamp", self.start, self.end))
        for grain in ("day", "week"):
            if grain in dims and dated:
                out = out.withColumn(grain, bucket(F.col("purchase_timestamp"), grain))
        if self.window if window is None else window:
            out = out.where("in_analytical_window")
        wanted = statuses or self.statuses
        if wanted:
            out = out.where(F.col("order_status").isin(*wanted))
        if "customer_state" in dims:
            out = out.join(self.t.dim_customer.select("customer_id", "customer_state"), "customer_id", "left")
        return out

    def items(self, dims: list[str]) -> DataFrame:
        """Item rows in scope with the columns that dims need, and no join that they don't."""
        out = self.t.items.join(self.orders(dims), "order_id")
        if "product_category" in dims:
            out = out.join(
                self.t.dim_product.selectExpr("product_id", "coalesce(category_name_en, category_name_pt) AS product_category"),
                "product_id",
                "left",
            )
        if "seller_state" in dims:
            out = out.join(self.t.dim_seller.select("seller_id", "seller_state"), "seller_id", "left")
        for name in ("product", "seller"):
            if name in dims:
                out = out.withColumn(name, F.col(f"{name}_id"))
        return out

    def compute(self, kpi: str, dims: list[str] | None = None, details: bool = False, **options) -> DataFrame:
        """dims, value, sample_size, coverage and data_quality of a KPI; no rows are lost for null dimensions.

        details keeps what a KPI tells beyond that (excluded rows, numerators, warnings). options: variant of
        avg_review_score, has_text of review_volume.
        """
        dims = dims or []
        check_dimensions(kpi, dims, self.clearance)
        out = getattr(self, f"_{kpi}")(dims, **options)
        more = [c for c in out.columns if c not in (*dims, "value", "sample_size", "coverage")] if details else []
        return out.select(*dims, "value", "sample_size", "coverage", quality_tier(F.col("coverage")).alias("data_quality"), *more)

    def _item_sum(self, dims: list[str], column: str) -> DataFrame:
        items = self.items(dims)
        out = items.groupBy(*dims).agg(F.sum(column).cast(MONEY).alias("value"), F.count("*").alias("sample_size"))
        reached = self.t.items.select("order_id").distinct().withColumn("has", F.lit(1))
        share = self.orders().select("order_id").join(reached, "order_id", "left").agg(
            (100.0 * F.count("has") / F.nullif(F.count("*"), F.lit(0))).alias("coverage")
        )
        return out.crossJoin(F.broadcast(share))

    def _revenue(self, dims: list[str]) -> DataFrame:
        return self._item_sum(dims, "price")

    def _freight_revenue(self, dims: list[str]) -> DataFrame:
        return self._item_sum(dims, "freight_value")

    def _quantity_sold(self, dims: list[str]) -> DataFrame:
        return self.items(dims).groupBy(*dims).agg(
            F.count("*").cast("double").alias("value"),
            F.count("*").alias("sample_size"),
        ).withColumn("coverage", F.lit(100.0))

    def _orders(self, dims: list[str]) -> DataFrame:
        return self.orders(dims).groupBy(*dims).agg(
            F.count_distinct("order_id").cast("double").alias("value"),
            F.count("*").alias("sample_size"),
        ).withColumn("coverage", F.lit(100.0))

    def _aov(self, dims: list[str]) -> DataFrame:
        totals = self.t.items.groupBy("order_id").agg(F.sum("price").alias("total"))
        out = self.orders(dims).join(totals, "order_id", "left").groupBy(*dims).agg(
            F.sum("total").alias("s"),
            F.count("total").alias("n"),
            F.count("*").alias("every"),
        )
        coverage = F.lit(None).cast("double") if dims else F.try_divide(100.0 * F.col("n"), F.col("every"))
        return out.select(
            *dims,
            F.try_divide(F.col("s").cast("double"), F.col("n")).alias("value"),
            F.col("n").alias("sample_size"),
            coverage.alias("coverage"),
        )

    def _delivery(self, dims: list[str], **values: Column) -> DataFrame:
        """values, with the orders left out for an invalid sequence of dates and for a missing date."""
        flag = F.col("delivery_data_quality_flag")
        missing = flag.isin("MISSING_CUSTOMER_DATE", "MISSING_CARRIER_DATE")
        return self.orders(dims, delivery=True).groupBy(*dims).agg(
            *(v.alias(n) for n, v in values.items()),
            F.count_if(flag == "VALID").alias("sample_size"),
            (100.0 * F.count_if(flag == "VALID") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"),
            F.count_if(flag == "INVALID_SEQUENCE").alias("excluded_invalid"),
            F.count_if(missing).alias("excluded_missing"),
            F.count("*").alias("total_in_scope"),
        )

    def _avg_delivery_days(self, dims: list[str]) -> DataFrame:
        return self._delivery(dims, value=F.avg(F.when(F.col("delivery_data_quality_flag") == "VALID", F.col("delivery_days"))))

    def _on_time_delivery_rate(self, dims: list[str]) -> DataFrame:
        valid = F.col("delivery_data_quality_flag") == "VALID"
        on_time = F.count_if(valid & (F.col("delivery_delay_days") <= 0))
        return self._delivery(dims, value=F.try_divide(on_time, F.count_if(valid)), numerator=on_time)

    def _avg_review_score(self, dims: list[str], variant: str = REVIEW_VARIANTS[0]) -> DataFrame:
        """By the latest review of an order, the average of its reviews, or all reviews alike (by their own date)."""
        if variant not in REVIEW_VARIANTS:
            raise ValueError(f"unknown variant {variant!r}")
        if variant == "review_level_average":
            if dims:
                raise ValueError("review_level_average has no dimensions: its reviews have another date than their orders")
            out = self.reviews([]).agg(F.avg("review_score").alias("value"), F.count("*").alias("sample_size"))
            return out.withColumn("coverage", F.when(F.col("sample_size") > 0, 100.0))
        score = "latest_review_score" if variant == REVIEW_VARIANTS[0] else "avg_review_score"
        rated = self.t.agg_order_reviews.select("order_id", score)
        out = self.orders(dims).join(rated, "order_id", "left").groupBy(*dims).agg(
            F.avg(score).alias("value"),
            F.count(score).alias("sample_size"),
            F.count("*").alias("eligible"),
        )
        coverage = F.lit(None).cast("double") if dims else F.try_divide(100.0 * F.col("sample_size"), F.col("eligible"))
        return out.withColumn("coverage", coverage)

    def reviews(self, dims: list[str]) -> DataFrame:
        """Reviews whose own creation date is in range, with their orders' context; time dimensions are that date's."""
        rows = self.t.fact_reviews.where(in_range("review_creation_date", self.start, self.end))
        out = rows.join(self.orders([d for d in dims if d not in ("day", "week", "month")], dated=False).drop("month"), "order_id")
        for grain in ("day", "week", "month"):
            if grain in dims:
                out = out.withColumn(grain, bucket(F.col("review_creation_date"), grain))
        return out

    def _review_volume(self, dims: list[str], has_text: bool = False) -> DataFrame:
        rows = self.reviews(dims)
        if has_text:
            rows = rows.where("has_text")
        out = rows.groupBy(*dims).agg(
            F.count("*").cast("double").alias("value"),
            F.count("*").alias("sample_size"),
            F.count_distinct("order_id").alias("distinct_orders"),
        )
        return out.withColumn("coverage", F.lit(100.0))

    def _repeat_purchase_rate(self, dims: list[str], minimum: int = MINIMUM_OBSERVATIONS) -> DataFrame:
        people = self.orders(window=False).groupBy("customer_unique_id").agg(F.count_distinct("order_id").alias("n"))
        out = people.agg(
            F.try_divide(F.count_if(F.col("n") >= 2), F.count("*")).alias("value"),
            F.count("*").alias("sample_size"),
            F.count_if(F.col("n") >= 2).alias("repeat_customers"),
        )
        few = F.when(F.col("sample_size") < minimum, F.format_string("%d customers, below the least of %d", F.col("sample_size"), F.lit(minimum)))
        return out.withColumn("coverage", F.lit(100.0)).withColumn("warning", few)


def compare_periods(tables: Canonical, current: str, previous: str, dim: str = "product_category") -> DataFrame:
    """Revenue of two months by segment in one scan: absolute and percent change (null where previous is 0 or null)."""
    rows = Kpi(tables, window=False).items([dim]).where(F.col("month").isin(current, previous))
    both = rows.groupBy(dim).agg(
        F.sum(F.when(F.col("month") == previous, F.col("price"))).cast(MONEY).alias("previous"),
        F.sum(F.when(F.col("month") == current, F.col("price"))).cast(MONEY).alias("current"),
    )
    change = F.col("current").cast("double") - F.col("previous").cast("double")
    return both.withColumn("absolute_change", F.round(change, 4)).withColumn(
        "percent_change",
        F.round(F.try_divide(100 * change, F.abs(F.col("previous").cast("double"))), 6),
    )


#: Contract values: KPI, source, grain, unit, classification.
CONTRACTS = (
    ("revenue", "fact_order_items", "item", "currency", "PUBLIC_ANALYTICAL"),
    ("freight_revenue", "fact_order_items", "item", "currency", "PUBLIC_ANALYTICAL"),
    ("quantity_sold", "fact_order_items", "item", "count", "PUBLIC_ANALYTICAL"),
    ("orders", "fact_orders", "order", "count", "PUBLIC_ANALYTICAL"),
    ("aov", "agg_order_items", "order", "currency", "PUBLIC_ANALYTICAL"),
    ("avg_delivery_days", "fact_orders", "order", "days", "PUBLIC_ANALYTICAL"),
    ("on_time_delivery_rate", "fact_orders", "order", "share", "PUBLIC_ANALYTICAL"),
    ("avg_review_score", "agg_order_reviews", "order", "score", "PUBLIC_ANALYTICAL"),
    ("review_volume", "fact_reviews", "review", "count", "PUBLIC_ANALYTICAL"),
    ("repeat_purchase_rate", "fact_orders", "customer", "share", "RESTRICTED"),
)


def contracts(spark) -> DataFrame:
    """CONTRACTS as a table."""
    return spark.createDataFrame(CONTRACTS, "kpi string, source_table string, grain string, unit string, classification string")


def overview(tables: Canonical, current: str, previous: str) -> DataFrame:
    """(kpi, previous, current, absolute_change, percent_change) of nine KPIs: one pass at order grain for both months, and one over reviews by their own date.

    The orders of both months are written first, so that no other order's items are grouped.
    """
    wanted = F.col("month").isin(current, previous)
    some = tables.only(tables.stored(f"orders of {previous} and {current}", lambda: tables.orders.where(wanted).select("order_id").distinct()))
    both = some.order_dates.where(wanted).join(
        some.agg_order_items.select("order_id", "item_price_total", "item_freight_total", "item_count"),
        "order_id",
        "left",
    )
    both = both.join(some.agg_order_reviews.select("order_id", "latest_review_score"), "order_id", "left")
    valid = F.col("delivery_data_quality_flag") == "VALID"
    values = {
        "revenue": F.sum("item_price_total"), "freight_revenue": F.sum("item_freight_total"), "quantity_sold": F.coalesce(F.sum("item_count"), F.lit(0)), "orders": F.count("*"),
        "aov": F.try_divide(F.sum("item_price_total").cast("double"), F.count("item_price_total")), "avg_delivery_days": F.avg(F.when(valid, F.col("delivery_days"))),
        "on_time_delivery_rate": F.try_divide(F.count_if(valid & (F.col("delivery_delay_days") <= 0)), F.count_if(valid)), "avg_review_score": F.avg("latest_review_score"),
    }
    months = both.groupBy("month").agg(*(v.cast("double").alias(k) for k, v in values.items()))
    rows = months.select(
        "month",
        F.explode(F.array(*(F.struct(F.lit(k).alias("kpi"), F.col(k).alias("v")) for k in values))).alias("x"),
    ).select("month", "x.*")
    volume = Kpi(tables, window=False).compute("review_volume", ["month"]).where(F.col("month").isin(current, previous))
    rows = rows.unionByName(volume.select("month", F.lit("review_volume").alias("kpi"), F.col("value").alias("v")))
    out = rows.groupBy("kpi").agg(
        F.round(F.max(F.when(F.col("month") == previous, F.col("v"))), 4).alias("previous"),
        F.round(F.max(F.when(F.col("month") == current, F.col("v"))), 4).alias("current"),
    )
    change = F.col("current") - F.col("previous")
    return out.withColumn("absolute_change", F.round(change, 4)).withColumn(
        "percent_change",
        F.round(F.try_divide(100 * change, F.abs("previous")), 4),
    )


def contract_violations(tables: Canonical, statuses: tuple[str, ...]) -> DataFrame:
    """(rule, value, n): statuses outside the contract's, and item rows without a category."""
    bad = tables.order_dates.where(~F.col("order_status").isin(*statuses)).groupBy(
        F.lit("status_not_allowed").alias("rule"),
        F.col("order_status").alias("value"),
    ).agg(F.count("*").alias("n"))
    none = Kpi(tables, window=False).items(["product_category"]).where("product_category IS NULL").agg(F.count("*").alias("n")).where("n > 0")
    return bad.unionByName(none.select(F.lit("category_missing").alias("rule"), F.lit("NULL").alias("value"), "n"))
