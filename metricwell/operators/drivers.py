"""Driver decomposition: price, volume and mix; segment contributions, their ranks and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pvm(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The bridge per by. groups: by, q0, r0, q1, r1 (rows and revenue of each category in both periods; 0 if absent)."""
    by = by or []
    g = groups.select(*by, *(F.col(c).cast("double").alias(c) for c in ("q0", "r0", "q1", "r1")))
    price = F.col("q1") * (F.coalesce(F.try_divide("r1", "q1"), F.lit(0.0)) - F.coalesce(F.try_divide("r0", "q0"), F.lit(0.0)))
    out = g.withColumn("p", price).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("q0", "r0", "q1", "r1", "p")))
    volume = F.when(F.col("q0") == 0, 0.0).otherwise((F.col("q1") - F.col("q0")) * F.try_divide("r0", "q0"))
    out = out.withColumn("total_change", F.col("r1") - F.col("r0")).withColumn("volume_effect", volume).withColumn("price_effect", F.col("p"))
    out = out.withColumn("mix_effect", F.col("total_change") - F.col("volume_effect") - F.col("price_effect"))
    sure = F.when((F.col("q0") >= 30) & (F.col("q1") >= 30), "HIGH").otherwise("LOW")
    return out.select(
        *by,
        F.round("total_change", 4).alias("total_change"),
        *(F.round(c, 2).alias(c) for c in ("volume_effect", "price_effect", "mix_effect")),
        sure.alias("confidence"),
    )


def two_periods(items: DataFrame, key: str, current: str, previous: str, n: str | None = None) -> DataFrame:
    """q0, r0, q1, r1 by key in one scan: no join aligns the periods. n: column of how many items a row sums, else each is one."""
    many = F.col(n) if n else F.lit(1).cast("long")
    count = lambda c: F.coalesce(F.sum(F.when(c, many)), F.lit(0))
    was, now = F.col("month") == previous, F.col("month") == current
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("price"))), F.lit(0)).cast("decimal(18,4)")
    return items.where(was | now).groupBy(key).agg(
        count(was).alias("q0"),
        money(was).alias("r0"),
        count(now).alias("q1"),
        money(now).alias("r1"),
    )


def segment_contributions(items: DataFrame, kinds: list[str], current: str, previous: str, n: str | None = None) -> DataFrame:
    """Change, percent, share of the total change and confidence of each segment of each kind, in one scan of items.

    n: column of how many items a row sums, else each row is one.
    Months and segments are aggregated by grouping sets; both periods and the months of history are sums over that.
    """
    sets = items.groupingSets([["month", k] for k in kinds], "month", *kinds).agg(
        F.grouping_id().alias("g"),
        (F.sum(n) if n else F.count("*")).alias("n"),
        F.sum("price").alias("p"),
    )
    bit = {k: 1 << (len(kinds) - 1 - i) for i, k in enumerate(kinds)}
    of = lambda value: F.coalesce(*(F.when(F.col("g").bitwiseAND(bit[k]) == 0, value(k)) for k in kinds))
    months = sets.select("month", "n", "p", of(F.lit).alias("segment_type"), of(lambda k: F.col(k).cast("string")).alias("segment_value"))
    was, now = F.col("month") == previous, F.col("month") == current
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0)).cast("decimal(18,4)")
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    two = months.groupBy("segment_type", "segment_value").agg(
        rows(was).alias("q0"),
        money(was).alias("r0"),
        rows(now).alias("q1"),
        money(now).alias("r1"),
        F.count_if(F.col("month") <= previous).alias("months"),
    )
    two = two.where("q0 + q1 > 0")
    change, n = F.col("r1") - F.col("r0"), F.col("q0") + F.col("q1")
    total = F.sum(change).over(Window.partitionBy("segment_type")).cast("double")
    percent = lambda whole: F.round(F.try_divide(100 * change.cast("double"), whole), 4)
    sure = F.when((F.col("months") >= 6) & (n >= 30), "HIGH").when((F.col("months") >= 2) | (n >= 5), "MEDIUM").otherwise("LOW")
    return two.select(
        "segment_type", "segment_value", F.col("r0").alias("previous"), F.col("r1").alias("current"), change.cast("decimal(18,4)").alias("absolute_change"),
        percent(F.col("r0").cast("double")).alias("percent_change"), percent(total).alias("share_of_total"), n.alias("sample_size"), F.col("months").alias("history_months"), sure.alias("confidence"),
    )


def ranked(segments: DataFrame) -> DataFrame:
    """rank by size of the change within each type, ties by value."""
    order = Window.partitionBy("segment_type").orderBy(F.desc(F.abs("absolute_change")), "segment_value")
    return segments.withColumn("rank", F.row_number().over(order))


def dimension_ranking(segments: DataFrame) -> DataFrame:
    """Largest and total absolute change of each segment type."""
    size = F.abs("absolute_change")
    return segments.groupBy("segment_type").agg(
        F.max(size).alias("max_contribution"),
        F.max_by("segment_value", F.struct(size, F.col("segment_value"))).alias("top_segment"),
        F.sum(size).cast("decimal(18,4)").alias("total_contribution"),
        F.count("*").alias("segments"),
    )


def change(items: DataFrame, current: str, previous: str) -> DataFrame:
    """(change): the difference of all prices of two months, from the items themselves."""
    of = lambda month: F.coalesce(F.sum(F.when(F.col("month") == month, F.col("price"))), F.lit(0))
    return items.agg((of(current) - of(previous)).cast("decimal(18,4)").alias("change"))


def reconciliation(segments: DataFrame, total: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per segment type: the sum of its changes, its distance from the total (change), and whether that is within tolerance."""
    out = segments.groupBy("segment_type").agg(F.sum("absolute_change").cast("decimal(18,4)").alias("sum_change")).crossJoin(F.broadcast(total))
    out = out.withColumn("distance", (F.col("change") - F.col("sum_change")).cast("decimal(18,4)")).drop("change")
    return out.withColumn("reconciled", F.abs("distance") <= tolerance)


def monthly_pvm(items: DataFrame, key: str) -> DataFrame:
    """The bridge of every month against the month before, by a dense (month x category) grid."""
    base = items.groupBy("month", key).agg(F.count("*").alias("q"), F.sum("price").cast("decimal(18,4)").alias("r"))
    zero = F.lit(0).cast("decimal(18,4)")
    now = base.select("month", key, F.lit(0).cast("long").alias("q0"), zero.alias("r0"), F.col("q").alias("q1"), F.col("r").alias("r1"))
    was = base.select(
        F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("month"),
        key,
        F.col("q").alias("q0"),
        F.col("r").alias("r0"),
        F.lit(0).cast("long").alias("q1"),
        zero.alias("r1"),
    )
    grid = now.unionByName(was).groupBy("month", key).agg(*(F.sum(c).alias(c) for c in ("q0", "r0", "q1", "r1")))
    known = base.select("month").distinct()
    return pvm(grid, ["month"]).join(F.broadcast(known), "month", "left_semi")


def driver_rows(bridge: DataFrame) -> DataFrame:
    """One row per driver of a bridge: effect, percent of the size of the change, direction."""
    rows = bridge.selectExpr("total_change", "stack(3, 'volume', volume_effect, 'price', price_effect, 'mix', mix_effect) AS (driver, effect)")
    direction = F.when(F.col("effect") > 0, "UP").when(F.col("effect") < 0, "DOWN").otherwise("FLAT")
    return rows.select(
        "driver",
        "effect",
        F.round(F.try_divide(100 * F.col("effect"), F.abs("total_change")), 2).alias("pct_of_change"),
        direction.alias("direction"),
    )


def worst_tier(*tiers: str):
    """The worst of several data-quality tiers: LOW, MEDIUM, UNKNOWN, HIGH."""
    every = F.array(*tiers)
    out = F.lit("HIGH")
    for name in ("UNKNOWN", "MEDIUM", "LOW"):
        out = F.when(F.array_contains(every, name), name).otherwise(out)
    return out


def contribution_tree(segments: DataFrame) -> DataFrame:
    """(segment_type, children): the ranked segments of each type as JSON."""
    nested = F.array_sort(F.collect_list(F.struct("rank", "segment_value")))
    return ranked(segments).groupBy("segment_type").agg(F.to_json(nested).alias("children"))


def allowed_segments(requested: list[str] | None, clearance: str) -> tuple[list[str], list[str]]:
    """Dimensions a caller may see and warnings; one asked for by name and not allowed is an error."""
    from .kpi import CLEARANCE, DIMENSION_CLEARANCE

    every = requested or ["product_category", "customer_state", "seller_state"]
    hidden = [d for d in every if CLEARANCE[DIMENSION_CLEARANCE.get(d, "PUBLIC_ANALYTICAL")] > CLEARANCE[clearance]]
    if hidden and requested:
        raise PermissionError(f"{', '.join(hidden)} need a higher clearance than {clearance}")
    return [d for d in every if d not in hidden], [f"{d} left out: needs {DIMENSION_CLEARANCE[d]}" for d in hidden]
