"""From driver signals to ranked actions; claims and their verification; feedback and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import store
from .evidence import CAUSAL
from .ordered import numbered, sorted_parts

# Weights of the confidence of an action and scores of its tiers.
WEIGHTS = {"driver": 0.35, "quality": 0.25, "history": 0.25, "link": 0.15}
LINK = {"WEAK": 0.25, "MODERATE": 0.6, "STRONG": 0.9}
EFFORT = {"LOW": 0.2, "MEDIUM": 0.5, "HIGH": 0.85}
CONTROL = {"LOW": 0.25, "MEDIUM": 0.55, "HIGH": 0.9}
QUALITY = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3, "UNKNOWN": 0.1}
LEAST_EFFORT = 0.05
# Words of a comment that put it into a category, in order.
KEYWORDS = (
    ("kpi definition", "KPI_DEFINITION"),
    ("excluded", "DATA"),
    ("refunded", "DATA"),
    ("data quality", "DATA"),
    ("driver", "DRIVER"),
    ("caused", "NARRATIVE"),
    ("evidence", "EVIDENCE"),
    ("confidence", "CONFIDENCE"),
    ("recommend", "RECOMMENDATION"),
    ("capacity", "RECOMMENDATION"),
    ("campaign", "NARRATIVE"),
    ("holiday", "NARRATIVE"),
    ("wording", "NARRATIVE"),
    ("narrative", "NARRATIVE"),
)
RATINGS = {"MISSING_DRIVER": "DRIVER", "WRONG_RECOMMENDATION": "RECOMMENDATION", "WRONG_CONFIDENCE": "CONFIDENCE"}
LOWER_IS_BETTER = ("unsupported_claim_rate",)


def scored(column: str, scores: dict[str, float], default: float | None = None) -> Column:
    """The score of a tier by name."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in scores.items() for x in pair))[F.col(column)], F.lit(default))


def candidates(signals: DataFrame, ontology: DataFrame) -> DataFrame:
    """Signals x the actions of their driver (an alias counts); a driver without actions gives none."""
    named = ontology.select(
        F.explode(F.array_union(F.array("driver"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("driver"),
        *(c for c in ontology.columns if c not in ("driver", "aliases")),
    )
    return signals.join(F.broadcast(named), "driver").withColumn("action", F.replace("template", F.lit("{target}"), F.col("target")))


def with_impact(actions: DataFrame) -> DataFrame:
    """estimated_effect (null if a factor is missing, which is named), confidence, control, effort and priority."""
    factors = ("effect", "population", "signal_confidence")
    out = actions.withColumn("estimated_effect", F.col("effect") * F.col("population") * F.col("signal_confidence")).withColumn(
        "missing",
        F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in factors))), ","),
    )
    sure = WEIGHTS["driver"] * F.coalesce(
        "signal_confidence",
        F.lit(0.0),
    ) + WEIGHTS["quality"] * scored(
        "data_quality", QUALITY, 0.1
    ) + WEIGHTS["history"] * F.coalesce("history", F.lit(0.0)) + WEIGHTS["link"] * scored("link", LINK, 0.25)
    out = out.withColumn(
        "confidence",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)),
    ).withColumn("control", scored("controllability", CONTROL, 0.25)).withColumn("effort_score", scored("effort", EFFORT, 0.85))
    return out.withColumn(
        "priority",
        F.coalesce(F.abs("estimated_effect"), F.lit(0.0)) * F.col("confidence") * F.col("control") / F.greatest("effort_score", F.lit(LEAST_EFFORT)),
    )


def with_revenue(actions: DataFrame, order_value: DataFrame) -> DataFrame:
    """actions with revenue_impact: the effect where its unit is currency, else times the average order value (aov, one row)."""
    impact = F.when(F.col("unit") == "currency", F.col("estimated_effect")).otherwise(F.col("estimated_effect") * F.col("aov"))
    return actions.crossJoin(F.broadcast(order_value)).withColumn("revenue_impact", impact).drop("aov")


def constraints(actions: DataFrame) -> DataFrame:
    """(action_id, constraint, status): budget_pct, utilization_pct, units, coverage and owner_allowed; unknown is a warning."""

    def band(c: str, blocked: Column, warning: Column) -> Column:
        return F.when(F.col(c).isNull(), "WARNING").when(blocked, "BLOCKED").when(warning, "WARNING").otherwise("PASS")

    status = {
        "budget": band("budget_pct", F.col("budget_pct") <= 0, F.col("budget_pct") < 20), "operational_capacity": band("utilization_pct", F.col("utilization_pct") >= 100, F.col("utilization_pct") >= 85),
        "inventory": band("units", F.col("units") <= 0, F.col("units") < 100), "geography": band("coverage", ~F.col("coverage"), F.lit(False)), "decision_rights": band("owner_allowed", ~F.col("owner_allowed"), F.lit(False)),
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("constraint_name"), s.alias("status")) for n, s in status.items())))
    return actions.select("action_id", "relevant", each.alias("x")).where(
        F.array_contains("relevant", F.col("x.constraint_name"))
    ).select("action_id", "x.*")


def rank_actions(actions: DataFrame, checked: DataFrame) -> DataFrame:
    """Tier by the worst constraint; rank by priority within a signal, blocked actions unranked; the first free one is TOP."""
    worst = checked.groupBy("action_id").agg(
        F.max(F.when(F.col("status") == "BLOCKED", 2).when(F.col("status") == "WARNING", 1).otherwise(0)).alias("w")
    )
    out = actions.join(worst, "action_id", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    order = Window.partitionBy("signal_id", "w").orderBy(F.desc(F.round("priority", 2)), "action_id")
    place = F.row_number().over(order)
    tier = F.when(F.col("w") == 2, "BLOCKED").when(F.col("w") == 1, "CONDITIONAL").when(place == 1, "TOP").otherwise("RANKED")
    return out.select(
        "signal_id",
        "action_id",
        F.round("priority", 2).alias("priority"),
        F.when(F.col("w") < 2, place).alias("place"),
        tier.alias("tier"),
    )


def monitoring(actions: DataFrame, rising: tuple[str, ...]) -> DataFrame:
    """A row for each KPI to watch: direction, expected effect where it is the signal's own, warning at half of it."""
    out = actions.select("action_id", "metric", "estimated_effect", F.explode("kpis").alias("kpi"))
    effect = F.when(F.col("kpi") == F.col("metric"), F.col("estimated_effect"))
    return out.select(
        "action_id",
        "kpi",
        F.when(F.col("kpi").isin(*rising), "increase").otherwise("decrease").alias("direction"),
        F.round(effect, 4).alias("expected_effect"),
        F.round(effect / 2, 4).alias("warning_threshold"),
    )


def numeric_claims(claims: DataFrame, least: float = 20.0) -> DataFrame:
    """(claim_id, position, value, unit) of the numbers in a text, 1,234.5 among them; bare years and small bare integers don't count."""
    found = F.regexp_extract_all("text", F.lit(r"[-+]?R?\$?\s?\d[\d,]*\.?\d*[KkMm]?(?![a-zA-Z])\s?%?"), F.lit(0))
    out = claims.select("claim_id", F.posexplode(found).alias("position", "raw"))
    times = F.when(F.col("raw").rlike("[Kk]"), 1_000.0).when(F.col("raw").rlike("[Mm]"), 1_000_000.0).otherwise(1.0)
    unit = F.when(
        F.col("raw").contains("%"),
        "percent",
    ).when(F.col("raw").contains("R$"), "BRL").when(F.col("raw").contains("$"), "USD").otherwise("unitless")
    out = out.withColumn("value", F.regexp_replace("raw", r"[^0-9.+-]", "").cast("double") * times).withColumn("unit", unit)
    bare = (F.col("unit") == "unitless") & ~F.col("raw").rlike("[KkMm]") & (F.col("value") == F.floor("value"))
    return out.where(~(bare & (F.col("value").between(1900, 2100) | (F.abs("value") < least)))).select("claim_id", "position", "value", "unit")


def match_numbers(numbers: DataFrame, allowed: DataFrame, tolerance: float = 0.0005, floor: float = 0.01) -> DataFrame:
    """Each number with whether an allowed value of the same unit lies within the tolerance, and the nearest one.

    Allowed values belong to the claim that may use them (claim_id, known, unit), so the join is on equal keys.
    """
    near = F.abs(F.col("value") - F.col("known"))
    fits = near <= F.greatest(tolerance * F.abs("known"), F.lit(floor))
    return numbers.join(allowed, ["claim_id", "unit"], "left").groupBy("claim_id", "position", "value", "unit").agg(
        F.coalesce(F.bool_or(fits), F.lit(False)).alias("matched"),
        F.min_by("known", F.struct(near, F.col("known"))).alias("nearest"),
    )


def language_violation(text: Column, claim_type: Column) -> Column:
    """True where the wording claims a cause that the type of claim doesn't allow; findings may hedge."""
    hedged = F.lower(text).contains("contributed mathematically") | F.lower(text).contains("mathematically explains")
    return text.rlike(CAUSAL) & ~((claim_type == "ANALYTICAL_FINDING") & hedged)


def verify_claims(claims: DataFrame, evidence: DataFrame, matched: DataFrame, recommendations: DataFrame) -> DataFrame:
    """status and the first failure of each claim: evidence, recommendation, strength, language, numbers, decoration.

    claims: claim_id, text, claim_type, cited (ids), recommendation (an id or null); evidence: evidence_id, claim_type,
    value; recommendations: recommendation, those that decisions have made.
    """
    rank = lambda c: F.array_position(F.array(*(F.lit(x) for x in ("UNKNOWN", "HYPOTHESIS", "ASSOCIATION", "FACT", "ANALYTICAL_FINDING"))), c)
    known = evidence.select("evidence_id", rank(F.col("claim_type")).alias("strength"), "value")
    cited = claims.select("claim_id", F.explode("cited").alias("evidence_id")).join(known, "evidence_id", "left").groupBy("claim_id").agg(
        F.count_if(F.col("strength").isNull()).alias("unknown"),
        F.max("strength").alias("strength"),
        F.count("value").alias("valued"),
    )
    numbers = matched.groupBy("claim_id").agg(F.count("*").alias("numbers"), F.count_if(~F.col("matched")).alias("wrong"))
    made = recommendations.select("recommendation").distinct().withColumn("made", F.lit(True))
    out = claims.join(cited, "claim_id", "left").join(numbers, "claim_id", "left").join(made, "recommendation", "left")
    reason = (
        F.when(F.col("unknown") > 0, "unknown_evidence").when(F.col("recommendation").isNotNull() & F.col("made").isNull(), "unsupported_recommendation").when(rank(F.col("claim_type")) > F.col("strength"), "stronger_than_evidence").when(language_violation(F.col("text"), F.col("claim_type")), "language")
        .when(F.col("wrong") > 0, "number").when(F.col("claim_type").isin("FACT", "ANALYTICAL_FINDING") & F.col("numbers").isNull() & (F.col("valued") > 0), "decorative_citation")
    )
    return out.withColumn("reason", reason).select(
        "claim_id",
        F.when(F.col("reason").isNull(), "APPROVED").otherwise("REJECTED").alias("status"),
        "reason",
    )


def verify_stories(verified: DataFrame, stories: DataFrame) -> DataFrame:
    """(story, claims_checked, claims_rejected, status): a story is approved if all of its claims are. stories: claim_id, story."""
    out = stories.join(verified, "claim_id").groupBy("story").agg(F.count("*").alias("claims_checked"), F.count_if(F.col("status") == "REJECTED").alias("claims_rejected"))
    return out.withColumn("status", F.when(F.col("claims_rejected") == 0, "APPROVED").otherwise("REJECTED"))


def persona_order(evidence: DataFrame, personas: DataFrame, size: int) -> DataFrame:
    """persona x evidence without excluded types, preferred metric first, then type and id; sections of size rows."""
    both = evidence.crossJoin(F.broadcast(personas)).where(~F.array_contains("excluded", F.col("evidence_type")))
    both = both.withColumn("_other", (F.col("subject") != F.col("preferred")).cast("int"))
    return numbered(both, "persona", ["_other", "evidence_type", "evidence_id"], "place").withColumn("position", F.col("place").cast("int")).select(
        "persona",
        "evidence_id",
        "position",
        F.floor((F.col("position") - 1) / size).cast("int").alias("section"),
    )


def categories(rating: Column, comment: Column) -> Column:
    """Distinct categories: that of the rating, then those of the words found, in order."""
    text = F.lower(F.coalesce(comment, F.lit("")))
    first = [F.when(rating == r, c) for r, c in RATINGS.items()]
    return F.array_distinct(F.array_compact(F.array(*first, *(F.when(text.contains(w), c) for w, c in KEYWORDS))))


def next_version(versions: DataFrame, column: str) -> DataFrame:
    """One row: v and the largest numeric suffix plus one."""
    return versions.agg(
        F.concat(
            F.lit("v"),
            (F.coalesce(F.max(F.regexp_extract(column, r"([0-9]+)$", 1).try_cast("long")), F.lit(0)) + 1).cast("string"),
        ).alias("next")
    )


def evaluate_cases(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """passed per declared dimension of each case (null if not declared). A case without an output fails.

    cases: case_id, forbidden, expected, driver, low, high, recommendation (a map, whose entries the output's must have);
    outputs: case_id, claims, driver_out, score, recommendation_out.
    """
    out = cases.join(outputs, "case_id", "left")
    absent = F.col("claims").isNull()
    no = lambda declared, ok: F.when(declared, F.coalesce(~absent & ok, F.lit(False)))
    return out.select(
        "case_id", no(F.size("forbidden") > 0, ~F.arrays_overlap("forbidden", "claims")).alias("forbidden_absent"), no(F.size("expected") > 0, F.size(F.array_except("expected", "claims")) == 0).alias("expected_present"),
        no(F.col("driver").isNotNull(), F.col("driver") == F.col("driver_out")).alias("driver_right"), no(F.col("low").isNotNull(), F.col("score").between(F.col("low"), F.col("high"))).alias("confidence_in_range"),
        no(F.col("recommendation").isNotNull(), F.forall(F.map_entries("recommendation"), lambda x: F.coalesce(F.try_element_at("recommendation_out", x["key"]) == x["value"], F.lit(False)))).alias("recommendation_right"),
    )


DIMENSIONS = ("forbidden_absent", "expected_present", "driver_right", "confidence_in_range", "recommendation_right")


def evaluation_metrics(results: DataFrame) -> DataFrame:
    """(metric, value, declared): the share passed of the cases that declare a dimension, and of unsupported claims."""
    each = [
        F.struct(
            F.lit(d).alias("metric"),
            F.round(F.avg(F.col(d).cast("double")), 6).alias("value"),
            F.count(d).alias("declared"),
        ) for d in DIMENSIONS
    ]
    each.append(
        F.struct(
            F.lit("unsupported_claim_rate").alias("metric"),
            F.round(1 - F.avg(F.col("forbidden_absent").cast("double")), 6).alias("value"),
            F.count("forbidden_absent").alias("declared"),
        )
    )
    return results.agg(F.array(*each).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def compare_metrics(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """delta and IMPROVED, REGRESSED or SAME per metric; for some metrics lower is better."""
    out = baseline.selectExpr("metric", "value AS baseline").join(candidate.selectExpr("metric", "value AS candidate"), "metric", "full_outer")
    delta = F.round(F.col("candidate") - F.col("baseline"), 6)
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -delta).otherwise(delta)
    return out.select(
        "metric",
        "baseline",
        "candidate",
        delta.alias("delta"),
        F.when(good > 0, "IMPROVED").when(good < 0, "REGRESSED").otherwise("SAME").alias("change"),
    )


def threshold_gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Whether each metric meets its limit: a minimum, or a maximum where lower is better."""
    ok = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return metrics.join(F.broadcast(limits), "metric").select("metric", "value", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def append(df: DataFrame, path: str) -> None:
    """Adds records to a log of Parquet files."""
    df.write.mode("append").parquet(path)


def run_candidates(cases: DataFrame, runner, schema: str) -> DataFrame:
    """Outputs of a caller's runner, made once per batch stream: runner() gives a function from a case (dict) to an output (dict)."""
    import pandas as pd

    def run(batches):
        one = runner()
        for b in batches:
            yield pd.DataFrame([one(r) for r in b.to_dict("records")])

    return cases.mapInPandas(run, schema)


def telemetry(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Roll-up of calls by investigation and role, by investigation, and over all (level 0, 1, 3): counts, tokens, cost, latency.

    calls: investigation, role, latency, input and output tokens; prices: role, model, price_in and price_out of a million
    tokens, a table of the models there are. Roles without a model are deterministic and cost nothing.
    """
    cost = F.round(F.col("input") / 1_000_000 * F.col("price_in") + F.col("output") / 1_000_000 * F.col("price_out"), 6)
    rows = calls.join(F.broadcast(prices), "role", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0)))
    return rows.rollup("investigation", "role").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("calls"),
        F.count("model").alias("llm_calls"),
        (F.count("*") - F.count("model")).alias("deterministic_calls"),
        F.sum("input").alias("input_tokens"),
        F.sum("output").alias("output_tokens"),
        F.round(F.sum("cost"), 6).alias("cost"),
        F.round(F.sum("latency"), 3).alias("latency"),
    )


def budget_breaches(spending: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(investigation, budget, budget_limit, used, id): the first spending of each budget that finds it used up.

    spending: investigation, at, id and a column for each budget. Running sums over sorted parts: a part adds up its own
    rows and starts from the sums of the parts before it, so that an investigation of any length is dealt to many tasks.
    Rows without a time or an id come last, and rows alike in both are spent at once. What is compared is the sum itself,
    not the rounded one that is shown. Spending without an investigation counts as one of its own.
    """
    names = list(limits)
    order = [F.asc_nulls_last("at"), F.asc_nulls_last("id")]
    parts = sorted_parts(spending, ["investigation", *order])
    sums = parts.groupBy("investigation", "part").agg(*(F.sum(b).alias(b) for b in names))
    earlier = Window.partitionBy("investigation").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = store(sums.select("investigation", "part", *(F.coalesce(F.sum(b).over(earlier), F.lit(0.0)).alias(f"{b}_0") for b in names)))
    here = Window.partitionBy("investigation", "part").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.alias("p").join(sums.alias("s"), F.col("p.investigation").eqNullSafe(F.col("s.investigation")) & (F.col("p.part") == F.col("s.part")))
    rows = rows.select("p.*", *(f"s.{b}_0" for b in names))
    used = rows.select("investigation", "at", "id", *names, *((F.col(f"{b}_0") + F.sum(b).over(here) - F.col(b)).alias(f"{b}_1") for b in names))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.lit(float(v)).alias("budget_limit"), F.col(b).alias("spent"), F.col(f"{b}_1").alias("used")) for b, v in limits.items())))
    over = used.select("investigation", "at", "id", each.alias("x")).select("investigation", "at", "id", "x.*").where("spent > 0 AND used >= budget_limit")
    place = F.struct(F.col("at").isNull(), "at", F.col("id").isNull(), "id", "used")  # of rows alike the one that finds least used
    first = over.groupBy("investigation", "budget", "budget_limit").agg(F.min_by(F.struct("used", "id"), place).alias("f"))
    return first.select("investigation", "budget", "budget_limit", F.round("f.used", 4).alias("used"), "f.id")


def audit_log(entries: DataFrame, **equal: str | None) -> DataFrame:
    """The entries of a log (at, id and others) whose columns have the values asked for, newest first; None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            entries = entries.where(F.col(name) == value)
    return entries.orderBy(F.desc("at"), F.desc("id"))
