"""Evidence rows from KPIs, movements, drivers and segments; their validation and who may see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kpi import CLEARANCE
from .text import redact

# The tier of each type of evidence, and wording that claims a cause.
TIERS = {
    "KPI_OBSERVATION": "T1_DESCRIPTIVE",
    "KPI_MOVEMENT": "T1_DESCRIPTIVE",
    "CONCURRENT_KPI": "T1_DESCRIPTIVE",
    "CUSTOMER_REVIEW": "T1_DESCRIPTIVE",
    "DRIVER_CONTRIBUTION": "T2_ARITHMETIC",
    "SEGMENT_CONTRIBUTION": "T2_ARITHMETIC",
    "ANOMALY_SIGNAL": "T3_STATISTICAL",
    "STATISTICAL_RESULT": "T3_STATISTICAL",
}
CAUSAL = r"(?i)\b(caused|because of|due to|led to|resulted in|driven by)\b"
CONFIDENCE = ("UNKNOWN", "LOW", "MEDIUM", "HIGH")


def evidence_id(prefix: str, *parts: str | Column) -> Column:
    """ev_<prefix>_ and 16 digits of a digest of the parts."""
    return F.concat(F.lit(f"ev_{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def worse(a: Column, b: Column) -> Column:
    """The lower of two confidences; null is UNKNOWN."""
    names = F.array(*(F.lit(x) for x in CONFIDENCE))
    rank = lambda c: F.greatest(F.array_position(names, F.coalesce(c, F.lit("UNKNOWN"))), F.lit(1))
    return F.element_at(names, F.least(rank(a), rank(b)).cast("int"))


def rows(df: DataFrame, kind: str, prefix: str, subject: Column, value: Column, confidence: Column, claim: Column, history: Column | None = None, seller: Column | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """Evidence of one kind: one row for each row of df, with the columns kept. Rows about sellers are INTERNAL."""
    level = F.when(seller, "INTERNAL").otherwise("PUBLIC_ANALYTICAL") if seller is not None else F.lit("PUBLIC_ANALYTICAL")
    return df.select(
        evidence_id(prefix, F.lit(kind), subject).alias("evidence_id"), F.lit(kind).alias("evidence_type"), F.lit(TIERS[kind]).alias("evidence_tier"), subject.alias("subject"), value.cast("double").alias("value"),
        confidence.alias("confidence"), claim.alias("claim"), (history if history is not None else F.lit(None)).cast("double").alias("historical_sufficiency"), level.alias("classification"), *kept,
    )


def violations(evidence: DataFrame) -> DataFrame:
    """(evidence_id, rule) of every broken rule: type without its tier, quality outside 0 to 1, no ISO time, nested
    metadata (JSON), causal wording, no claim."""
    tier = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.col("evidence_type")]
    rules = {
        "tier": ~F.coalesce(tier == F.col("evidence_tier"), F.lit(False)), "quality_range": F.coalesce(~F.col("historical_sufficiency").between(0, 1), F.lit(False)),
        "time": F.try_to_timestamp(F.col("retrieved_at")).isNull(), "metadata": F.coalesce(F.col("metadata").rlike(r"^\{.*[\[\{]"), F.lit(False)),
        "causal_wording": F.coalesce(F.col("claim").rlike(CAUSAL), F.lit(False)), "claim_missing": F.coalesce(F.trim("claim"), F.lit("")) == "",
    }
    broken = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    return evidence.select("evidence_id", F.explode(broken).alias("rule"))


def visible(evidence: DataFrame, clearance: str) -> DataFrame:
    """Rows at or below a clearance; an unknown classification is hidden."""
    allowed = [k for k, v in CLEARANCE.items() if v <= CLEARANCE[clearance]]
    return evidence.where(F.col("classification").isin(*allowed))


def redacted(text: Column, personal: Column) -> tuple[Column, Column]:
    """A text as retrieval may show it, and whether it was redacted: where it holds personal data."""
    return F.when(personal, redact(text)).otherwise(text), F.when(personal, "REDACTED_AT_RETRIEVAL").otherwise("NOT_REDACTED")


def policy_violations(log: DataFrame, roles: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls of tools that the caller's role may not use. log: user_id, tool; roles: user_id, role; policy: role, tool."""
    return log.join(roles, "user_id", "left").join(F.broadcast(policy), ["role", "tool"], "left_anti")


def clearance_of(role: Column, levels: dict[str, str]) -> Column:
    """The clearance of a role; roles that are not named see what is public."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair))[role], F.lit("PUBLIC_ANALYTICAL"))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z of two shares; null without rows or where the pooled share is 0 or 1."""
    p = (x1 + x2) / F.nullif(n1 + n2, F.lit(0))
    return F.when((n1 > 0) & (n2 > 0) & (p > 0) & (p < 1), (x2 / n2 - x1 / n1) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))
