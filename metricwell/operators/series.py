"""Baselines, anomaly signals and tiers, for all series and periods in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY, LEAST, SPAN = 6, 3, 3
#: Values that an exponential mean looks back on: what lies before them weighs less than a double shows (0.5 ** 64).
REACH = 64


def baselines(series: DataFrame) -> DataFrame:
    """series (series_id, period 'yyyy-MM', value, sample_size) with the baselines that precede each period.

    Null values don't count as history: the last six are the last six that are not null. Needs three for mean, median
    and spread, two for the exponential mean, two earlier years for the seasonal mean.
    """
    past = Window.partitionBy("series_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    season = Window.partitionBy("series_id", F.substring("period", 6, 2)).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    # by the number of values before each row, null rows don't count and the frame stays bounded
    recent = Window.partitionBy("series_id").orderBy("n_history").rangeBetween(-REACH, -1)
    out = series.withColumn("n_history", F.count("value").over(past).cast("int")).withColumn("all", F.collect_list("value").over(recent))
    out = out.withColumn("h", F.slice("all", F.greatest(F.size("all") - HISTORY + 1, F.lit(1)), HISTORY))
    n = F.size("h")
    total = lambda a, f=lambda x: x: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    mean = F.when(n >= LEAST, total(F.col("h")) / n)
    out = out.withColumn("rolling_mean", mean).withColumn("rolling_median", F.when(n >= LEAST, _median(F.col("h"))))
    spread = F.when(n >= LEAST, F.sqrt(total(F.col("h"), lambda x: (x - F.col("rolling_mean")) * (x - F.col("rolling_mean"))) / (n - 1)))
    alpha = 2 / (SPAN + 1)
    smooth = F.when(
        F.size("all") >= 2,
        F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, v: alpha * v + (1 - alpha) * a),
    )
    out = out.withColumn("rolling_std", spread).withColumn("ewma", smooth).withColumn("previous_period", F.get("all", F.size("all") - 1))
    out = out.withColumn("seasonal", F.when(F.count("value").over(season) >= 2, F.avg("value").over(season)))
    out = out.withColumn("baseline", F.coalesce("seasonal", "rolling_mean", "ewma", "previous_period"))
    name = F.when(F.col("seasonal").isNotNull(), "seasonal").when(F.col("rolling_mean").isNotNull(), "rolling_mean").when(F.col("ewma").isNotNull(), "ewma").when(
        F.col("previous_period").isNotNull(),
        "previous_period",
    )
    return out.withColumn("method", name).drop("all")


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(
        (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    )


def signals(based: DataFrame) -> DataFrame:
    """z, robust z (null without spread) and percentile rank of value against its history h."""
    out = based.withColumn("z", F.try_divide(F.col("value") - F.col("rolling_mean"), F.nullif(F.col("rolling_std"), F.lit(0.0))))
    away = F.transform("h", lambda x: F.abs(x - F.col("rolling_median")))
    out = out.withColumn("mad", F.when(F.col("rolling_median").isNotNull(), 1.4826 * _median(away)))
    out = out.withColumn("robust_z", F.try_divide(F.col("value") - F.col("rolling_median"), F.nullif(F.col("mad"), F.lit(0.0))))
    return out.withColumn(
        "percentile",
        F.when((F.size("h") > 0) & F.col("value").isNotNull(), 100.0 * F.size(F.filter("h", lambda x: x <= F.col("value"))) / F.size("h")),
    )


def tier(ratio: Column, steps: tuple[float, float, float]) -> Column:
    """0 to 3 by the steps that ratio reaches; 0 for null."""
    return F.when(ratio >= steps[2], 3).when(ratio >= steps[1], 2).when(ratio >= steps[0], 1).otherwise(0)


def materiality(signal: DataFrame, absolute: float, relative: float, z: float = 2.0, impact: float | None = None) -> DataFrame:
    """Magnitude, statistical and business tiers, their median, and the verdict's score."""
    change = F.col("value") - F.col("baseline")
    out = signal.withColumn("change", change).withColumn("change_pct", F.try_divide(100 * change, F.abs(F.nullif(F.col("baseline"), F.lit(0.0)))))
    out = out.withColumn("magnitude_tier", tier(F.greatest(F.abs("change") / absolute, F.abs("change_pct") / relative), (1, 2, 4)))
    out = out.withColumn("statistical_tier", tier(F.greatest(F.abs("z"), F.abs("robust_z")) / z, (1, 1.5, 2.5)))
    out = out.withColumn("impact_tier", tier(F.abs("change") / (impact or absolute), (1, 2, 4)))
    three = F.array("magnitude_tier", "statistical_tier", "impact_tier")
    out = out.withColumn("combined_tier", F.get(F.array_sort(three), F.lit(1))).withColumn(
        "score",
        F.round((F.col("magnitude_tier") + F.col("statistical_tier") + F.col("impact_tier")) / 9.0, 3),
    )
    name = F.when(F.col("value").isNull() | F.col("baseline").isNull(), "INSUFFICIENT_DATA").otherwise(
        F.element_at(F.array(*(F.lit(x) for x in ("NORMAL", "WATCH", "MATERIAL", "CRITICAL"))), F.col("combined_tier") + 1)
    )
    return out.withColumn("verdict", name)


def impact(material: DataFrame, additive: bool, name: str, minimum: float | None = None) -> DataFrame:
    """kpi_kind, magnitude, affected_population, meets_minimum and interpretation of each row.

    The change of an additive KPI is an amount; that of a rate or mean is a shift of its own unit over the population.
    """
    missing = F.col("value").isNull() | F.col("baseline").isNull()
    magnitude = F.when(~missing, F.round(F.col("value") - F.col("baseline"), 2 if additive else 4))
    people = F.when(F.col("sample_size") > 0, F.col("sample_size"))
    amount = F.format_string(f"{name} moved by %+.4f from its baseline to %.4f", magnitude, F.round("value", 4))
    shift = F.format_string(f"{name} moved by %+.4f of its own unit over %d observations", magnitude, F.col("sample_size"))
    told = F.when(missing, F.lit(f"{name}: no impact without a value and a baseline")).otherwise(amount if additive else shift)
    meets = F.when(~missing, F.abs(magnitude) >= minimum) if minimum else F.lit(None).cast("boolean")
    return material.select(
        "series_id",
        "period",
        F.lit("additive" if additive else "rate_or_average").alias("kpi_kind"),
        magnitude.alias("magnitude"),
        people.alias("affected_population"),
        meets.alias("meets_minimum"),
        told.alias("interpretation"),
    )


def detect(series: DataFrame, absolute: float, relative: float, least: int, coverage: float | None = None) -> DataFrame:
    """Everything above for all series and periods: baselines, signals, tiers, caps, verdict and persistence."""
    based = materiality(agreement(signals(baselines(series))), absolute, relative)
    return persistence(verdict(based, absolute, relative, least, coverage=coverage), absolute, relative)


def change_stats(ts: DataFrame, window: int, value: str = "value", key: str = "series_id") -> DataFrame:
    """Percent change, rolling mean and spread including the row itself, and z; at least max(2, window // 2) rows."""
    order = Window.partitionBy(key).orderBy("period")
    frame = order.rowsBetween(-(window - 1), 0)
    enough = F.count(value).over(frame) >= max(2, window // 2)
    out = ts.withColumn("pct_change", 100 * (F.try_divide(F.col(value), F.nullif(F.lag(value).over(order), F.lit(0.0))) - 1))
    out = out.withColumn("roll_mean", F.when(enough, F.avg(value).over(frame))).withColumn("roll_std", F.when(enough, F.stddev(value).over(frame)))
    return out.withColumn("roll_z", F.try_divide(F.col(value) - F.col("roll_mean"), F.nullif(F.col("roll_std"), F.lit(0.0))))


def select_level(levels: DataFrame, least: int, keys: list[str]) -> DataFrame:
    """The first sufficient level of each entity; the last one, marked insufficient, where there is none.

    levels: keys, level, level_rank, n_periods (not null), observations; one row per entity and level. A level suffices
    with LEAST periods and least observations. The reason names all levels passed over.
    """
    fine = (F.col("n_periods") >= LEAST) & (F.coalesce("observations", F.lit(0)) >= least)
    rows = F.array_sort(F.collect_list(F.struct("level_rank", "level", "n_periods", "observations", fine.alias("fine"))))
    out = levels.groupBy(*keys).agg(rows.alias("l")).withColumn("good", F.filter("l", lambda x: x["fine"]))
    out = out.withColumn("chosen", F.coalesce(F.get("good", F.lit(0)), F.element_at("l", -1))).withColumn("insufficient", F.size("good") == 0)
    skipped = F.array_join(F.transform(F.filter("l", lambda x: x["level_rank"] < F.col("chosen.level_rank")), lambda x: x["level"]), ", ")
    reason = F.when(F.col("insufficient"), "all_levels_insufficient").when(skipped != "", F.concat(skipped, F.lit("_history_insufficient")))
    first = F.get("l", F.lit(0))["level_rank"]
    out = out.withColumn("confidence", level_confidence(F.col("chosen.n_periods"), F.col("chosen.level_rank") > first, F.col("insufficient")))
    return out.select(
        *keys,
        F.col("chosen.level").alias("level"),
        F.col("chosen.n_periods").alias("n_periods"),
        F.col("chosen.observations").alias("observations"),
        reason.alias("fallback_reason"),
        "insufficient",
        "confidence",
    )


def level_confidence(n_periods: Column, fallback: Column, insufficient: Column) -> Column:
    """NONE if insufficient; HIGH or MEDIUM for the first level, MEDIUM or LOW for one fallen back to."""
    healthy = n_periods >= 2 * LEAST
    return F.when(insufficient, "NONE").when(
        ~fallback,
        F.when(healthy, "HIGH").otherwise("MEDIUM"),
    ).otherwise(F.when(healthy, "MEDIUM").otherwise("LOW"))


def agreement(signal: DataFrame) -> DataFrame:
    """signals_agree (z and robust z at most 1 apart, null without both) and the caveats of short histories."""
    n = F.size("h")
    notes = F.array_compact(F.array(F.when(n < 6, "directional_only"), F.when(n < 3, "no_percentile").when(n < 10, "coarse_percentile")))
    return signal.withColumn("signals_agree", F.abs(F.col("z") - F.col("robust_z")) <= 1).withColumn("caveats", F.array_join(notes, ","))


def verdict(material: DataFrame, absolute: float, relative: float, least: int, confidence: Column | None = None, coverage: float | None = None) -> DataFrame:
    """The final verdict: disagreement of the baselines first (no score), then caps at WATCH.

    Methods disagree if their magnitude tiers lie two or more apart, unless the seasonal baseline leads. Low confidence
    in the baseline (by default that of its own level), a sample under least or, if coverage is given, a share of that
    series covered (column coverage, percent) below it caps the verdict.
    """
    change = lambda b: F.col("value") - F.col(b)
    of = lambda b: F.when(F.col(b).isNotNull(), tier(F.greatest(F.abs(change(b)) / absolute, F.abs(F.try_divide(100 * change(b), F.nullif(F.col(b), F.lit(0.0)))) / relative), (1, 2, 4)))
    tiers = F.array_compact(F.array(*(of(b) for b in ("seasonal", "rolling_mean", "ewma", "previous_period"))))
    sure = level_confidence(F.least("n_history", F.lit(10_000)), F.lit(False), F.col("n_history") < LEAST) if confidence is None else confidence
    poor = F.coalesce(F.col("sample_size") < least, F.lit(True))
    if coverage is not None:
        poor = poor | F.coalesce(F.col("coverage") < coverage, F.lit(True))
    out = material.withColumn(
        "spread",
        F.array_max(tiers) - F.array_min(tiers),
    ).withColumn("baseline_confidence", sure).withColumn("low_quality", poor)
    split = (F.col("method") != "seasonal") & (F.size(tiers) >= 2) & (F.col("spread") >= 2)
    capped = F.col("baseline_confidence").isin("LOW", "NONE") | F.col("low_quality")
    final = F.when(capped, F.least("combined_tier", F.lit(1))).otherwise(F.col("combined_tier"))
    named = F.element_at(F.array(*(F.lit(x) for x in ("NORMAL", "WATCH", "MATERIAL", "CRITICAL"))), final + 1)
    missing = F.col("value").isNull() | F.col("baseline").isNull()
    out = out.withColumn("final_verdict", F.when(missing, "INSUFFICIENT_DATA").when(split, "BASELINE_DISAGREEMENT").otherwise(named))
    return out.withColumn("final_score", F.when(~missing & ~split, F.col("score"))).withColumn(
        "capped",
        F.coalesce(~missing & ~split & capped & (F.col("combined_tier") > 1), F.lit(False)),
    )


def persistence(material: DataFrame, absolute: float, relative: float, required: int = 2) -> DataFrame:
    """ONE_OFF, REVERSING, PERSISTENT, TRENDING or UNKNOWN by the periods that follow each one, and how many it affects.

    Later periods are held against the same baseline; the run ends at the first that is null, back to normal or turned.
    """
    base, delta = F.col("baseline"), F.col("value") - F.col("baseline")
    far = lambda v, base: F.greatest(F.abs(v - base) / absolute, F.abs(F.try_divide(100 * (v - base), F.nullif(base, F.lit(0.0)))) / relative) >= 1
    alike = lambda v, value, base: F.when(value == base, F.lit(False)).otherwise((v > base) == (value > base))
    moved, same = lambda v: far(v, base), lambda v: alike(v, F.col("value"), base)
    start = F.struct(F.lit(0).alias("run"), F.lit(True).alias("open"), F.lit(None).cast("double").alias("last"))

    def later(x: Column, i: Column) -> Column:
        """The row x with the first value after it, and its run: one array for each series, not one for each row."""

        def step(state: Column, row: Column) -> Column:
            goes = state["open"] & F.coalesce(far(row["value"], x["baseline"]) & alike(row["value"], x["value"], x["baseline"]), F.lit(False))
            return F.struct(
                (state["run"] + goes.cast("int")).alias("run"),
                goes.alias("open"),
                F.when(goes, F.abs(row["value"] - x["baseline"])).otherwise(state["last"]).alias("last"),
            )

        return F.struct(
            x.alias("row"),
            F.get("rows", i + 1)["value"].alias("first"),
            F.aggregate(F.slice("rows", i + 2, F.size("rows")), start, step).alias("run"),
        )

    whole = material.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("period", *(c for c in material.columns if c != "period")))).alias("rows")
    )
    out = whole.select(F.explode(F.transform("rows", later)).alias("x")).select("x.row.*", "x.first", "x.run")
    unknown = F.col("value").isNull() | base.isNull() | F.col("first").isNull()
    affected = F.when(F.col("value").isNull() | base.isNull(), 0).when(
        unknown | ~moved(F.col("first")) | ~same(F.col("first")),
        1,
    ).otherwise(1 + F.col("run.run"))
    name = (
        F.when(unknown, "UNKNOWN").when(~moved(F.col("first")), "ONE_OFF").when(~same(F.col("first")), "REVERSING")
        .when((1 + F.col("run.run") >= required) & (F.col("run.last") > F.abs(delta)), "TRENDING").otherwise("PERSISTENT")
    )
    return out.withColumn("persistence", name).withColumn("periods_affected", affected).drop("first", "run")
