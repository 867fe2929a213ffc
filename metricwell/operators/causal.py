"""Hypotheses: group slices, trends, eligibility, methods, contradiction and confidence, for all hypotheses at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Months before and after a treatment: below HARD a check fails, below SOFT it is a concern.
PRE_HARD, PRE_SOFT, POST_HARD, POST_SOFT = 3, 12, 1, 3
CHECKS = (
    "treatment_exists",
    "outcome_exists",
    "treatment_precedes_outcome",
    "sufficient_pre_period",
    "sufficient_post_period",
    "treatment_variation",
    "control_variation",
    "sample_size",
    "missingness",
    "confounders",
    "consistent_grain",
    "consistent_kpi_definition",
)


def group_slices(items: DataFrame, dim: str) -> DataFrame:
    """Each group of dim with its revenue and rows, and those of all others together."""
    every = Window.partitionBy(F.lit(1))
    out = items.groupBy(dim).agg(F.sum("price").cast("decimal(18,4)").alias("value"), F.count("*").alias("sample"))
    return out.withColumn(
        "rest_value",
        (F.sum("value").over(every) - F.col("value")).cast("decimal(18,4)"),
    ).withColumn("rest_sample", F.sum("sample").over(every) - F.col("sample"))


def parallel_trends(series: DataFrame, dim: str, limit: float = 0.5) -> DataFrame:
    """Slopes of each group and of all others before the treatment; parallel if their gap is small against the larger one.

    series: dim, t, value before the treatment. Fewer than two periods fail.
    """
    total = series.groupBy("t").agg(F.sum("value").alias("total"))
    both = series.join(total, "t").withColumn("rest", F.col("total") - F.col("value"))
    out = both.groupBy(dim).agg(F.count("*").alias("periods"), F.regr_slope("value", "t").alias("s"), F.regr_slope("rest", "t").alias("r"))
    ratio = F.abs(F.col("s") - F.col("r")) / F.greatest(F.abs("r"), F.lit(1e-9))
    return out.select(
        dim,
        "periods",
        F.round("s", 4).alias("slope"),
        F.round("r", 4).alias("rest_slope"),
        F.round(ratio, 6).alias("ratio"),
        F.coalesce((F.col("periods") >= 2) & (ratio <= limit), F.lit(False)).alias("parallel"),
    )


def lag1_autocorrelation(series: DataFrame, split: int) -> DataFrame:
    """Lag-1 autocorrelation of the residuals of two lines, up to split and after it; null under three points or without spread."""
    post = F.col("t") > split
    side = Window.partitionBy("series_id", post)
    fit = series.withColumn("e", F.col("value") - (F.regr_intercept("value", "t").over(side) + F.regr_slope("value", "t").over(side) * F.col("t")))
    order = Window.partitionBy("series_id").orderBy("t")
    fit = fit.withColumn("d", F.col("e") - F.avg("e").over(Window.partitionBy("series_id"))).withColumn("p", F.lag("d").over(order))
    sums = fit.groupBy("series_id").agg(F.count("e").alias("n"), F.sum(F.col("d") * F.col("p")).alias("a"), F.sum(F.col("d") * F.col("d")).alias("b"))
    r = F.when((F.col("n") >= 3) & (F.col("b") > 1e-9), F.col("a") / F.col("b"))
    return sums.select("series_id", "n", F.round(r, 4).alias("r1"), F.coalesce(F.abs(r) <= 0.5, F.lit(False)).alias("passed"))


def _level(n: Column, hard: int | Column, soft: int | Column) -> Column:
    return F.when(n < hard, "HARD_FAIL").when(n < soft, "SOFT_FAIL").otherwise("PASS")


def eligibility_checks(h: DataFrame, kpis: tuple[str, ...], dimensions: tuple[str, ...]) -> DataFrame:
    """(hypothesis_id, position, check_name, status): the twelve checks of every hypothesis, in their order.

    h: hypothesis_id, outcome, treatment, dimension, control_group (null if none), unit, pre_months, post_months,
    treatment_end, outcome_start, treated_rows, control_rows, outcome_rows, minimum_rows, coverage, events, in_window.
    """
    group, known = F.col("dimension").isNotNull(), F.col("outcome").isin(*kpis)
    if_known = lambda c: F.when(~known, "NOT_APPLICABLE").otherwise(c)
    ok = lambda c, bad="HARD_FAIL": F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise(bad)
    status = (
        ok(F.when(group, known & F.col("dimension").isin(*dimensions)).otherwise(F.col("treatment").isin(*kpis))), ok(known), ok(~group & (F.col("treatment_end") <= F.col("outcome_start"))),
        if_known(_level(F.coalesce("pre_months", F.lit(0)), PRE_HARD, PRE_SOFT)), if_known(_level(F.coalesce("post_months", F.lit(0)), POST_HARD, POST_SOFT)), ok(F.col("treated_rows") >= 1),
        F.when(~group & F.col("control_group").isNull(), "NOT_APPLICABLE").otherwise(ok(F.col("control_group").isNotNull() & (F.col("control_rows") >= 1))),
        if_known(_level(F.coalesce("outcome_rows", F.lit(0)), F.col("minimum_rows") / 2, F.col("minimum_rows"))), if_known(F.when(F.col("coverage").isNull(), "SOFT_FAIL").otherwise(_level(F.col("coverage"), F.lit(47.5), F.lit(95.0)))),
        ok(F.col("events") == 0, "SOFT_FAIL"), if_known(ok(F.col("unit").isin("order", "review", "month", "day", "week", *dimensions))), if_known(ok(F.col("in_window"))),
    )
    return h.select(
        "hypothesis_id",
        F.posexplode(
            F.array(*(F.struct(F.lit(n).alias("check_name"), s.alias("status")) for n, s in zip(CHECKS, status, strict=True)))
        ).alias("position", "x"),
    ).select("hypothesis_id", "position", "x.check_name", "x.status")


def eligibility_verdict(checks: DataFrame) -> DataFrame:
    """CAUSAL_INELIGIBLE if only the order in time fails hard, INELIGIBLE for other hard failures, else by soft ones."""
    hard = F.sort_array(F.collect_list(F.when(F.col("status") == "HARD_FAIL", F.col("check_name"))))
    out = checks.groupBy("hypothesis_id").agg(hard.alias("h"), F.count_if(F.col("status") == "SOFT_FAIL").alias("soft"))
    only = (F.size("h") == 1) & F.array_contains("h", "treatment_precedes_outcome")
    name = F.when(only, "CAUSAL_INELIGIBLE").when(F.size("h") > 0, "INELIGIBLE").when(F.col("soft") > 0, "PARTIALLY_ELIGIBLE").otherwise("ELIGIBLE")
    return out.select("hypothesis_id", name.alias("verdict"), F.array_join("h", ",").alias("hard_fails"), "soft")


def select_method(h: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The first method whose needs are met. h as for eligibility_checks, with proposed (a method or null)."""
    out = h.join(verdicts, "hypothesis_id")
    failed = lambda name: F.array_contains(F.split("hard_fails", ","), name)
    did = F.col("dimension").isNotNull() & F.col("control_group").isNotNull() & ~failed("sufficient_pre_period") & ~failed(
        "treatment_precedes_outcome"
    )
    its = F.col("dimension").isNull() & ~failed("sufficient_pre_period") & ~failed("sufficient_post_period")
    name = (
        F.when(F.col("verdict") == "CAUSAL_INELIGIBLE", "NONE").when((F.col("outcome") == "revenue") & (F.col("proposed") == "PVM"), "PVM").when(F.col("verdict") == "INELIGIBLE", "NONE")
        .when(did, "DIFFERENCE_IN_DIFFERENCES").when(its, "INTERRUPTED_TIME_SERIES").when(F.col("proposed") == "EXPERIMENTAL_RESULT", "EXPERIMENTAL_RESULT").otherwise("DESCRIPTIVE_ASSOCIATION")
    )
    return out.select("hypothesis_id", "verdict", name.alias("method"))


def result_status(selected: DataFrame, passed: Column) -> DataFrame:
    """Tier and status of each estimate: a causal claim needs passed diagnostics and full eligibility."""
    quasi = F.col("method").isin("DIFFERENCE_IN_DIFFERENCES", "INTERRUPTED_TIME_SERIES")
    claim = quasi & passed & (F.col("verdict") == "ELIGIBLE")
    tier = F.when(claim, "T3_QUASI_EXPERIMENTAL").when((F.col("method") == "PVM") | (quasi & passed), "T2_ARITHMETIC").otherwise("T1_DESCRIPTIVE")
    out = selected.withColumn("evidence_tier", tier).withColumn("claim_allowed", claim)
    status = F.when(F.col("verdict") == "CAUSAL_INELIGIBLE", "CAUSAL_REJECTED").when(F.col("evidence_tier") == "T2_ARITHMETIC", "ARITHMETIC_ONLY").when(
        F.col("evidence_tier") == "T1_DESCRIPTIVE",
        "DESCRIPTIVE_ONLY",
    ).otherwise("CAUSAL_SUPPORTED")
    return out.withColumn("status", status)


def classification_floor(classified: DataFrame) -> DataFrame:
    """Concurrent KPIs are context; evidence of low or unknown confidence, blocked, or from under 15 rows is insufficient."""
    weak = F.col("confidence").isin("LOW", "UNKNOWN") | (F.col("safety") == "BLOCKED") | (F.col("sample_size") < 15)
    return classified.withColumn(
        "classification",
        F.when(
            F.col("evidence_type") == "CONCURRENT_KPI",
            "CONTEXT",
        ).when(F.coalesce(weak, F.lit(False)), "INSUFFICIENT").otherwise(F.col("classification")),
    )


def contradictions(classified: DataFrame, tests: DataFrame) -> DataFrame:
    """severity per hypothesis by the number of contradicting pieces and a z test (hypothesis_id, z, n)."""
    out = classified.groupBy("hypothesis_id").agg(
        F.count_if(F.col("classification") == "CONTRADICTS").alias("contradicts")
    ).join(tests, "hypothesis_id", "left")
    strong = F.coalesce((F.abs("z") >= 1.96) & (F.col("n") >= 30), F.lit(False))
    name = F.when(
        (strong & (F.col("contradicts") >= 1)) | (F.col("contradicts") >= 3),
        "STRONG",
    ).when(strong | (F.col("contradicts") >= 2), "MODERATE").when((F.col("contradicts") == 1) | F.col("z").isNotNull(), "WEAK").otherwise("NONE")
    return out.select("hypothesis_id", "contradicts", name.alias("severity"))


def rank_methods(classified: DataFrame, severity: DataFrame) -> DataFrame:
    """T2_ARITHMETIC, T1_DESCRIPTIVE or INSUFFICIENT_DATA by the supporting tiers, one rank lower on strong contradiction."""
    supports = F.col("classification") == "SUPPORTS"
    has = lambda *t: F.coalesce(F.bool_or(supports & F.col("evidence_tier").isin(*t)), F.lit(False))
    out = classified.groupBy("hypothesis_id").agg(
        F.when(has("T2_ARITHMETIC"), 2).when(has("T1_DESCRIPTIVE", "T3_STATISTICAL"), 1).otherwise(0).alias("r")
    ).join(severity, "hypothesis_id")
    down = (F.col("severity") == "STRONG") & (F.col("r") > 0)
    rank = F.col("r") - down.cast("int")
    return out.select(
        "hypothesis_id",
        F.element_at(F.array(*(F.lit(x) for x in ("INSUFFICIENT_DATA", "T1_DESCRIPTIVE", "T2_ARITHMETIC"))), rank + 1).alias("method"),
        down.alias("downgraded"),
    )


def confidence(classified: DataFrame, severity: DataFrame, methods: DataFrame) -> DataFrame:
    """Weighted score of each hypothesis, its level with caps, and abstention."""
    yes = F.col("classification") == "SUPPORTS"
    mean = lambda c, absent: F.coalesce(F.avg(F.when(yes, F.col(c))), F.when(F.count_if(yes) > 0, absent).otherwise(0.0))
    out = classified.groupBy("hypothesis_id").agg(
        (F.count_if(yes) / F.count("*")).alias("completeness"),
        F.count_if(yes).alias("supports"),
        mean("reliability", 0.0).alias("rel"),
        mean("freshness", 0.6).alias("fresh"),
        mean("history", 0.5).alias("hist"),
        F.bool_or("retrieval_failed").alias("failed"),
    )
    out = out.join(severity, "hypothesis_id").join(methods, "hypothesis_id")
    penalty = F.when(F.col("severity") == "STRONG", 1.0).when(
        F.col("severity") == "MODERATE",
        0.5,
    ).when(F.col("severity") == "WEAK", 0.15).otherwise(0.0)
    raw = 0.25 * F.col(
        "completeness"
    ) + 0.20 * F.col("rel") + 0.15 * F.col("fresh") + 0.15 * F.col("hist") - 0.30 * penalty - 0.10 * F.col("failed").cast("int")
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    level = F.when(
        F.col("score") >= 0.75,
        F.when(F.col("severity") == "STRONG", "MEDIUM").otherwise("HIGH"),
    ).when(F.col("score") >= 0.5, "MEDIUM").when(F.col("score") > 0, "LOW").otherwise("ABSTAIN")
    level = F.when(
        (F.col("supports") == 0) | (F.col("method") == "INSUFFICIENT_DATA"),
        "ABSTAIN",
    ).when(F.col("failed") & (F.col("completeness") < 0.3), "NEEDS_CLARIFICATION").otherwise(level)
    return out.select(
        "hypothesis_id",
        F.round("completeness", 6).alias("completeness"),
        "supports",
        F.round("score", 6).alias("score"),
        level.alias("level"),
    )
