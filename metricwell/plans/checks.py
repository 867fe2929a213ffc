"""Queries of groups E and L: rules on contracts, review workflows, numbers against all evidence, telemetry, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import decisions as L
from ..operators import ordered as O
from .bundle import _CLAIM, claims, observations
from .sql import Registry

query = Registry()

# L10: numbers of all claims against the values of all evidence
_KNOWN = "SELECT DISTINCT unit, known FROM (SELECT unit, known FROM alw UNION ALL SELECT 'BRL', sum(price)::DOUBLE FROM kpi_items GROUP BY month) WHERE known IS NOT NULL"
query("l10_matched_numbers", f"""WITH {_CLAIM}, kn AS ({_KNOWN}) SELECT claim_id, position, value, n.unit, coalesce(bool_or(abs(value - known) <= greatest(0.0005 * abs(known), 0.01)), false) AS matched, round(first(known ORDER BY abs(value - known), known), 4) AS nearest
    FROM num n LEFT JOIN kn ON n.unit = kn.unit GROUP BY ALL""")(lambda c: matched(c))  # fmt: skip


def matched(c):
    rows = c.stored("claims", lambda: claims(c))
    known = rows.select(F.expr("stack(2, 'BRL', double(v), 'percent', double(p)) AS (unit, known)"))
    known = known.unionByName(observations(c).select(F.lit("BRL").alias("unit"), F.col("value").alias("known")))
    return O.match_values(L.numeric_claims(rows), known).withColumn("nearest", F.round("nearest", 4))


# L18: an event type stands for a step of a review: a signup hands feedback in, a view reviews it, a purchase approves it
# for evaluation, an error rejects it; clicks decide nothing.
_DECIDED = {"signup": "SUBMIT", "view": "REVIEWED", "purchase": "APPROVED", "error": "REJECTED"}
MOVES = {(s, "SUBMIT"): "PENDING" for s in ("NONE", "PENDING", "REVIEWED", "APPROVED", "REJECTED")} | {
    ("PENDING", "REVIEWED"): "REVIEWED",
    ("REVIEWED", "REVIEWED"): "REVIEWED",
    ("REVIEWED", "APPROVED"): "APPROVED",
    ("PENDING", "REJECTED"): "REJECTED",
    ("REVIEWED", "REJECTED"): "REJECTED",
}
_STEP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DECIDED.items()) + " END"
query("l18_illegal_transitions", f"""WITH h AS (SELECT user_id, event_id, {_STEP} AS step, row_number() OVER w AS pos, count(*) FILTER (event_type = 'signup') OVER w AS turn FROM events WHERE event_type <> 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, turn, min(pos) FILTER (step = 'REVIEWED') AS reviewed, min(pos) FILTER (step = 'REJECTED') AS rejected FROM h GROUP BY ALL),
    t AS (SELECT user_id, turn, any_value(reviewed) AS reviewed, any_value(rejected) AS rejected, min(pos) FILTER (step = 'APPROVED' AND pos > reviewed) AS approved FROM h JOIN r USING (user_id, turn) GROUP BY ALL),
    e AS (SELECT h.*, reviewed, CASE WHEN turn > 0 THEN least(rejected, approved) END AS ended, CASE WHEN rejected <= coalesce(approved, rejected) THEN 'REJECTED' ELSE 'APPROVED' END AS how FROM h JOIN t USING (user_id, turn))
    SELECT user_id, event_id, step AS decision, CASE WHEN turn = 0 THEN 'NONE' WHEN pos > ended THEN how WHEN reviewed < pos THEN 'REVIEWED' ELSE 'PENDING' END AS state
    FROM e WHERE step <> 'SUBMIT' AND (turn = 0 OR pos > ended OR (step = 'APPROVED' AND coalesce(reviewed > pos, true)))""")(lambda c: illegal(c))  # fmt: skip


def illegal(c):
    """Decisions that the workflow forbids: after an end, of what was never handed in, and approval before a review."""
    steps = c.raw("events").select("user_id", "ts", "event_id", F.expr(_STEP).alias("decision")).where("decision IS NOT NULL")
    ran = O.run_automaton(steps, "user_id", ["ts", "event_id"], "decision", MOVES, "NONE")
    return ran.where("NOT legal").select("user_id", "event_id", "decision", F.col("before").alias("state"))


# E17: contracts made of parts, each with its own faults
_KPIS = ("revenue", "repeat_purchase_rate", "avg_delivery_days", "avg_review_score", "aov")
_AGG = ("SUM", "RATIO", "AVG", "DERIVED_RATIO")


def contracts(c):
    """A contract for each part; by its number and type it breaks some of the rules, or none. Brand 13's are there twice."""
    n = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    text = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    rows = c.raw("part").select(
        n.alias("contract_id"), pick(_KPIS, n).alias("kpi"), pick(_AGG, n).alias("aggregation"), (n % 6 != 1).alias("has_ratio"), text(n % 7 == 1, "order", "customer_unique_id over time").alias("base_grain"),
        F.array(F.lit("fact_orders"), text(n % 11 == 0, "order_log", "dim_seller")).alias("source_tables"),
        F.array(text(n % 3 == 0, "agg_order_items.item_price_total", "fact_order_items.freight"), text(n % 4 == 0, "fact_payments.payment_value", "fact_orders.customer_unique_id")).alias("source_columns"),
        F.array(F.struct(F.lower("p_type").alias("name"), text(n % 13 == 0, "dim_weather", "dim_product").alias("source_table"), (n % 5 != 2).alias("supported"), F.when(n % 2 == 0, "no source").alias("unsupported_reason"))).alias("dimensions"),
        F.array(F.struct(F.lit(C.DELIVERY_FLAG).alias("source_column"), (n % 9 != 0).alias("applied_by_default"))).alias("filters"),
        F.array(F.struct(F.lit(C.REVIEW_VARIANTS[0]).alias("variant_id"), (n % 8 != 0).alias("is_default")), F.struct(text(n % 10 == 3, "other", C.REVIEW_VARIANTS[1]).alias("variant_id"), (n % 16 == 1).alias("is_default"))).alias("variants"),
        F.array(F.struct(F.col("p_brand").alias("driver_name"), F.when(n % 17 != 0, n % 19 == 0).alias("is_causal_claim"))).alias("drivers"), F.when(n % 23 != 0, n % 29 == 0).alias("materiality_implemented"), F.when(n % 15 != 3, "REVIEW_GOVERNANCE").alias("review_governance_reference"),
        "p_brand",
    )
    return rows.unionByName(rows.where("p_brand = 'Brand#13'")).drop("p_brand")


_PARTS = f"""k AS (SELECT p_partkey AS n, {list(_KPIS)}[p_partkey % {len(_KPIS)} + 1] AS kpi, {list(_AGG)}[p_partkey % {len(_AGG)} + 1] AS aggregation, lower(p_type) AS dimension, p_brand FROM part),
    kk AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE p_brand = 'Brand#13')"""
_BROKEN = {
    "ratio_missing": ("kpi", f"aggregation IN {C.RATIOS} AND n % 6 = 1"),
    "not_one_default": ("kpi", "(n % 8 <> 0)::INTEGER + (n % 16 = 1)::INTEGER <> 1"),
    "revenue_source": ("kpi", "kpi = 'revenue' AND n % 3 <> 0"),
    "revenue_from_payments": ("kpi", "kpi = 'revenue' AND n % 4 = 0"),
    "repeat_customer": ("kpi", "kpi = 'repeat_purchase_rate' AND n % 4 = 0"),
    "repeat_grain": ("kpi", "kpi = 'repeat_purchase_rate' AND n % 7 = 1"),
    "delivery_filter": ("kpi", "kpi = 'avg_delivery_days' AND n % 9 = 0"),
    "review_reference": ("kpi", "kpi = 'avg_review_score' AND n % 15 = 3"),
    "review_variants": ("kpi", "kpi = 'avg_review_score' AND n % 10 = 3"),
    "materiality": ("kpi", "n % 23 = 0 OR n % 29 = 0"),
    "unknown_table": ("'order_log'", "n % 11 = 0"),
    "unknown_dimension_table": ("dimension", "n % 13 = 0"),
    "no_unsupported_reason": ("dimension", "n % 5 = 2 AND n % 2 <> 0"),
    "causal_driver": ("p_brand", "n % 17 = 0 OR n % 19 = 0"),
}
query("e17_contract_rules", f"WITH {_PARTS} SELECT n AS contract_id, 'duplicate_contract' AS rule, kpi AS subject FROM k WHERE p_brand = 'Brand#13' UNION ALL " + " UNION ALL ".join(f"SELECT n, '{r}', {s} FROM kk WHERE {t}" for r, (s, t) in _BROKEN.items()))(
    lambda c: C.contract_rules(contracts(c))
)

# L27, L28: an event is a call of an agent for a user's investigation; its value is the latency, k of props the tokens.
#: Model, and price of a million input and output tokens, by type of event; what is not listed is deterministic and free.
PRICES = {"view": ("large", 0.59, 0.79), "click": ("small", 0.05, 0.08), "purchase": ("mixed", 0.24, 0.24)}
_TOKENS = "regexp_extract(props, '([0-9]+)', 1)"
_CALLS = f"""SELECT user_id::VARCHAR AS investigation, event_type AS role, p.model, value AS latency, CASE WHEN p.model IS NULL THEN 0 ELSE coalesce(nullif({_TOKENS}, '')::BIGINT, 0) * 10 END AS input, CASE WHEN p.model IS NULL THEN 0 ELSE coalesce(nullif({_TOKENS}, '')::BIGINT, 0) * 3 END AS output, price_in, price_out
    FROM events LEFT JOIN (VALUES {', '.join(str((r, *v)) for r, v in PRICES.items())}) p(role, model, price_in, price_out) ON role = event_type"""
_COST = "coalesce(round(input / 1000000.0::DOUBLE * price_in + output / 1000000.0::DOUBLE * price_out, 6), 0)"
query("l27_cost_by_role", f"""SELECT investigation, role, grouping_id(investigation, role) AS level, count(*) AS calls, count(model) AS llm_calls, count(*) - count(model) AS deterministic_calls, sum(input)::BIGINT AS input_tokens, sum(output)::BIGINT AS output_tokens,
    round(sum({_COST}), 6) AS cost, round(sum(latency), 3) AS latency FROM ({_CALLS}) GROUP BY ROLLUP (investigation, role)""")(lambda c: L.telemetry(calls(c), prices(c)))  # fmt: skip


def prices(c):
    return c.spark.createDataFrame([(r, *v) for r, v in PRICES.items()], "role string, model string, price_in double, price_out double")


def calls(c):
    """investigation, role, at, id, latency, input and output tokens of each call."""
    n = F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))
    known = F.col("event_type").isin(*PRICES)
    return c.raw("events").select(F.col("user_id").cast("string").alias("investigation"), F.col("event_type").alias("role"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("latency"), F.when(known, n * 10).otherwise(0).alias("input"), F.when(known, n * 3).otherwise(0).alias("output"))


BUDGETS = {"agent_calls": 40, "tool_calls": 10, "retrieval_calls": 10, "tokens": 15_000, "latency_seconds": 1500.0}
_SPENT = {"agent_calls": "1", "tool_calls": "(event_type = 'click')::INTEGER", "retrieval_calls": "(event_type = 'view')::INTEGER", "tokens": f"CASE WHEN event_type IN {tuple(PRICES)} THEN coalesce(nullif({_TOKENS}, '')::BIGINT, 0) * 13 ELSE 0 END", "latency_seconds": "value"}
query("l28_budget_breach", " UNION ALL ".join(f"""SELECT user_id::VARCHAR AS investigation, '{b}' AS budget, {BUDGETS[b]}::DOUBLE AS budget_limit, round(first(used ORDER BY ts, event_id), 4)::DOUBLE AS used, first(event_id ORDER BY ts, event_id) AS id
    FROM (SELECT *, sum({e}) OVER (PARTITION BY user_id ORDER BY ts, event_id) - coalesce({e}, 0) AS used, coalesce({e}, 0) AS spent FROM events) WHERE spent > 0 AND used >= {BUDGETS[b]} GROUP BY 1""" for b, e in _SPENT.items()))(
    lambda c: L.budget_breaches(spending(c), BUDGETS)
)


def spending(c):
    return calls(c).select(
        "investigation", "at", "id", F.lit(1.0).alias("agent_calls"), (F.col("role") == "click").cast("double").alias("tool_calls"), (F.col("role") == "view").cast("double").alias("retrieval_calls"),
        (F.col("input") + F.col("output")).cast("double").alias("tokens"), F.coalesce("latency", F.lit(0.0)).alias("latency_seconds"),
    )
