"""Queries of groups J and L: the bundle of evidence, access to it, decisions, claims and feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decisions as L
from ..operators import drivers as D
from ..operators import evidence as E
from ..operators import kpi as K
from .analytics import _NOW, _WAS, _items, _seg_sql, item_sums, segments, summed
from .movement import _DETECT, _OVER, _PVM1, detected
from .sql import Registry

query = Registry()


# J
def _row(kind: str, prefix: str, subject: str, value: str, conf: str, claim: str, source: str, hist: str = "NULL", level: str = "'PUBLIC_ANALYTICAL'") -> str:
    return f"SELECT 'ev_{prefix}_' || substr(sha256('{kind}|' || {subject}), 1, 16) AS evidence_id, '{kind}' AS evidence_type, '{E.TIERS[kind]}' AS evidence_tier, {subject} AS subject, ({value})::DOUBLE AS value, {conf} AS confidence, {claim} AS claim, ({hist})::DOUBLE AS historical_sufficiency, {level} AS classification FROM {source}"


_OBS = "(SELECT month, sum(price) AS v, count(*) AS n FROM kpi_items GROUP BY 1)"
_PARTS = {
    "observation": _row("KPI_OBSERVATION", "obs", "'revenue:' || month", "v", "CASE WHEN n >= 30 THEN 'HIGH' WHEN n >= 5 THEN 'MEDIUM' ELSE 'LOW' END", "'revenue in ' || month || ' from ' || n || ' items'", _OBS),
    "movement": _row("KPI_MOVEMENT", "mov", "kpi", "absolute_change", "CASE WHEN previous IS NULL OR current IS NULL THEN 'LOW' ELSE 'HIGH' END", "kpi || ' moved'", "overview"),
    "driver": _row("DRIVER_CONTRIBUTION", "drv", "driver", "effect", "'HIGH'", "driver || ' effect on revenue'", "(WITH p AS (" + _PVM1 + ") SELECT 'volume' AS driver, round(volume, 2) AS effect FROM p UNION ALL SELECT 'price', round(price, 2) FROM p UNION ALL SELECT 'mix', round(total - volume - price, 2) FROM p)"),
    "segment": _row("SEGMENT_CONTRIBUTION", "seg", "segment_type || ':' || segment_value", "absolute_change", "confidence", "CASE WHEN segment_type = 'seller_state' THEN 'change driven by ' ELSE 'change in ' END || segment_value", "seg", "least(1.0, history_months / 6::DOUBLE)", "CASE WHEN segment_type = 'seller_state' THEN 'INTERNAL' ELSE 'PUBLIC_ANALYTICAL' END"),
    "signal": _row("ANOMALY_SIGNAL", "sig", "series_id", "score", "CASE WHEN n_history >= 6 THEN 'HIGH' WHEN n_history >= 3 THEN 'MEDIUM' ELSE 'LOW' END", "series_id || ' scored'", f"b4 WHERE period = '{_NOW}'", "least(1.0, n_history / 3::DOUBLE)"),
    "statistic": _row("STATISTICAL_RESULT", "sta", "series_id", "round(z, 4)", "CASE WHEN n_history >= 6 THEN 'HIGH' WHEN n_history >= 3 THEN 'MEDIUM' ELSE 'LOW' END", "series_id || ' against its history'", f"b4 WHERE period = '{_NOW}'"),
}
_BUNDLE = f"{_OVER}, {_seg_sql()}, {_DETECT}, ev AS ({' UNION ALL '.join(_PARTS.values())})"


def observations(c):
    months = summed(c).withColumnRenamed("price", "v")
    sure = F.when(F.col("n") >= 30, "HIGH").when(F.col("n") >= 5, "MEDIUM").otherwise("LOW")
    return E.rows(
        months,
        "KPI_OBSERVATION",
        "obs",
        F.concat(F.lit("revenue:"), "month"),
        F.col("v"),
        sure,
        F.format_string("revenue in %s from %d items", "month", "n"),
    )


def movements(c):
    sure = E.worse(F.when(F.col("previous").isNull(), "LOW").otherwise("HIGH"), F.when(F.col("current").isNull(), "LOW").otherwise("HIGH"))
    return E.rows(K.overview(c, _NOW, _WAS), "KPI_MOVEMENT", "mov", F.col("kpi"), F.col("absolute_change"), sure, F.concat("kpi", F.lit(" moved")))


def drivers(c):
    rows = D.driver_rows(D.pvm(D.two_periods(summed(c, "product_category"), "product_category", _NOW, _WAS, "n")))
    return E.rows(
        rows,
        "DRIVER_CONTRIBUTION",
        "drv",
        F.col("driver"),
        F.col("effect"),
        F.lit("HIGH"),
        F.concat("driver", F.lit(" effect on revenue")),
    )


def segment_rows(c):
    seller = F.col("segment_type") == "seller_state"
    claim = F.concat(F.when(seller, "change driven by ").otherwise("change in "), "segment_value")
    return E.rows(
        segments(c),
        "SEGMENT_CONTRIBUTION",
        "seg",
        F.concat_ws(":", "segment_type", "segment_value"),
        F.col("absolute_change"),
        F.col("confidence"),
        claim,
        F.least(F.lit(1.0), F.col("history_months") / 6),
        seller,
    )


def anomalies(c):
    now = detected(c).where(F.col("period") == _NOW)
    sure = F.when(F.col("n_history") >= 6, "HIGH").when(F.col("n_history") >= 3, "MEDIUM").otherwise("LOW")
    signal = E.rows(
        now,
        "ANOMALY_SIGNAL",
        "sig",
        F.col("series_id"),
        F.col("score"),
        sure,
        F.concat("series_id", F.lit(" scored")),
        F.least(F.lit(1.0), F.col("n_history") / 3),
    )
    return signal.unionByName(
        E.rows(now, "STATISTICAL_RESULT", "sta", F.col("series_id"), F.round("z", 4), sure, F.concat("series_id", F.lit(" against its history")))
    )


def bundle(c):
    item_sums(c)  # which all parts but the movements are made of
    return reduce(lambda a, b: a.unionByName(b), (f(c) for f in (observations, movements, drivers, segment_rows, anomalies)))


query("j2_kpi_observations", f"SELECT * FROM ({_PARTS['observation']})")(observations)
query("j3_kpi_movements", f"WITH {_OVER} {_PARTS['movement']}")(movements)
query("j4_anomaly_rows", f"WITH {_DETECT} {_PARTS['signal']} UNION ALL {_PARTS['statistic']}")(anomalies)
query("j5_bundle", f"WITH {_BUNDLE} SELECT * FROM ev")(bundle)
_LABELS = ", ".join(f"'{k}'" for k in E.CONFIDENCE)
_RULES = {
    "tier": "CASE evidence_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.TIERS.items()) + " END IS DISTINCT FROM evidence_tier",
    "quality_range": "coalesce(NOT historical_sufficiency BETWEEN 0 AND 1, false)",
    "time": "coalesce(try_cast(retrieved_at AS TIMESTAMP) IS NULL, true)",
    "metadata": "coalesce(regexp_matches(metadata, '^\\{.*[\\[\\{]'), false)",
    "causal_wording": f"coalesce(regexp_matches(claim, '{E.CAUSAL}'), false)",
    "claim_missing": "coalesce(trim(claim), '') = ''",
}
#: Evidence as others hand it in: events as rows, whose type, time, quality, metadata and claim may all be wrong.
_FOREIGN = f"""SELECT 'ev_log_' || event_id AS evidence_id, {[*E.TIERS][:4]}[event_id % 4 + 1] AS evidence_type, CASE WHEN event_id % 7 = 0 THEN 'T3_STATISTICAL' ELSE 'T1_DESCRIPTIVE' END AS evidence_tier,
    value / 100 AS historical_sufficiency, CASE WHEN event_id % 11 = 0 THEN 'yesterday' WHEN event_id % 13 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS retrieved_at,
    CASE WHEN event_id % 5 = 0 THEN '{{"a": ' || props || '}}' ELSE props END AS metadata, CASE WHEN event_id % 3 = 0 THEN 'an ' || event_type || ' due to demand' WHEN event_id % 17 > 0 THEN event_type END AS claim FROM events"""
query("j6_violations", f"WITH {_BUNDLE}, own AS (SELECT evidence_id, evidence_type, evidence_tier, historical_sufficiency, '{_NOW}-01' AS retrieved_at, '{{}}' AS metadata, claim FROM ev UNION ALL {_FOREIGN}) " + " UNION ALL ".join(f"SELECT evidence_id, '{n}' AS rule FROM own WHERE {t}" for n, t in _RULES.items()))(
    lambda c: E.violations(bundle(c).withColumn("retrieved_at", F.lit(f"{_NOW}-01")).withColumn("metadata", F.lit("{}")).select(*_EVIDENCE).unionByName(foreign(c).select(*_EVIDENCE)))
)
_EVIDENCE = ("evidence_id", "evidence_type", "evidence_tier", "historical_sufficiency", "retrieved_at", "metadata", "claim")


def foreign(c):
    n, kinds = F.col("event_id"), F.array(*map(F.lit, [*E.TIERS][:4]))
    return c.raw("events").select(
        F.concat(F.lit("ev_log_"), n.cast("string")).alias("evidence_id"), F.element_at(kinds, (n % 4 + 1).cast("int")).alias("evidence_type"),
        F.when(n % 7 == 0, "T3_STATISTICAL").otherwise("T1_DESCRIPTIVE").alias("evidence_tier"), (F.col("value") / 100).alias("historical_sufficiency"),
        F.when(n % 11 == 0, "yesterday").when(n % 13 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("retrieved_at"),
        F.when(n % 5 == 0, F.concat(F.lit('{"a": '), "props", F.lit("}"))).otherwise(F.col("props")).alias("metadata"),
        F.when(n % 3 == 0, F.concat(F.lit("an "), "event_type", F.lit(" due to demand"))).when(n % 17 > 0, F.col("event_type")).alias("claim"),
    )


query("j9_two_proportions", f"""SELECT customer_state, x1, n1, x2, n2, round(CASE WHEN n1 > 0 AND n2 > 0 AND x1 + x2 > 0 AND x1 + x2 < n1 + n2 THEN (x2 / n2::DOUBLE - x1 / n1::DOUBLE) / sqrt((x1 + x2) / (n1 + n2)::DOUBLE * (1 - (x1 + x2) / (n1 + n2)::DOUBLE) * (1 / n1::DOUBLE + 1 / n2::DOUBLE)) END, 6) AS z FROM (
    SELECT customer_state, count(*) FILTER (month < '1998-01' AND order_status = 'delivered') AS x1, count(*) FILTER (month < '1998-01') AS n1, count(*) FILTER (month >= '1998-01' AND order_status = 'delivered') AS x2, count(*) FILTER (month >= '1998-01') AS n2 FROM fact_orders GROUP BY 1)""")(
    lambda c: K.Kpi(c, window=False).orders(["customer_state"]).groupBy("customer_state").agg(*(F.count_if(F.expr(t)).alias(n) for n, t in (("x1", "month < '1998-01' AND order_status = 'delivered'"), ("n1", "month < '1998-01'"), ("x2", "month >= '1998-01' AND order_status = 'delivered'"), ("n2", "month >= '1998-01'")))).withColumn("z", F.round(E.two_proportion_z(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")), 6))
)
query(
    "j11_visible_evidence",
    f"WITH {_BUNDLE} SELECT evidence_id, evidence_type, subject FROM ev WHERE classification = 'PUBLIC_ANALYTICAL'",
)(lambda c: E.visible(bundle(c), "PUBLIC_ANALYTICAL").select("evidence_id", "evidence_type", "subject"))
#: Roles are the customers' segments; tools are the kinds of event. Allowed pairs:
_POLICY = (
    ("BUILDING", "view"),
    ("BUILDING", "click"),
    ("MACHINERY", "view"),
    ("MACHINERY", "purchase"),
    ("FURNITURE", "error"),
    ("HOUSEHOLD", "signup"),
    ("HOUSEHOLD", "view"),
)
_LEVEL = {"BUILDING": "PUBLIC_ANALYTICAL", "HOUSEHOLD": "PUBLIC_ANALYTICAL", "MACHINERY": "INTERNAL", "FURNITURE": "RESTRICTED"}
query("j16_policy_violations", f"""SELECT event_id, user_id, c_mktsegment AS role, event_type AS tool, CASE c_mktsegment {' '.join(f"WHEN '{r}' THEN '{v}'" for r, v in _LEVEL.items())} ELSE 'PUBLIC_ANALYTICAL' END AS clearance
    FROM events LEFT JOIN customer ON c_custkey = user_id WHERE (c_mktsegment, event_type) NOT IN (VALUES {', '.join(map(str, _POLICY))}) OR c_mktsegment IS NULL""")(
    lambda c: E.policy_violations(c.raw("events").select("event_id", "user_id", F.col("event_type").alias("tool")), c.raw("customer").selectExpr("c_custkey AS user_id", "c_mktsegment AS role"), c.spark.createDataFrame(_POLICY, "role string, tool string"))
    .select("event_id", "user_id", "role", "tool", E.clearance_of(F.col("role"), _LEVEL).alias("clearance"))
)
query("l26_audit_filtered", f"""SELECT event_id AS id, user_id, role, tool, decision, ts FROM (SELECT event_id, user_id, ts, c_mktsegment AS role, event_type AS tool, CASE WHEN (c_mktsegment, event_type) IN (VALUES {', '.join(map(str, _POLICY))}) THEN 'ALLOWED' ELSE 'DENIED' END AS decision
    FROM events LEFT JOIN customer ON c_custkey = user_id) WHERE role = 'MACHINERY' AND decision = 'DENIED' AND tool = 'error'""")(lambda c: L.audit_log(audited(c), role="MACHINERY", decision="DENIED", tool="error", user_id=None).withColumnRenamed("at", "ts"))  # fmt: skip


def audited(c):
    """The log with the role of each caller and whether the policy lets it use the tool."""
    policy = c.spark.createDataFrame(_POLICY, "role string, tool string").withColumn("decision", F.lit("ALLOWED"))
    rows = c.raw("events").selectExpr("event_id AS id", "user_id", "ts AS at", "event_type AS tool").join(c.raw("customer").selectExpr("c_custkey AS user_id", "c_mktsegment AS role"), "user_id", "left")
    return rows.join(F.broadcast(policy), ["role", "tool"], "left").select("id", "user_id", "role", "tool", F.coalesce("decision", F.lit("DENIED")).alias("decision"), "at")


query(
    "j18_listing",
    f"WITH {_BUNDLE} SELECT evidence_type, count(*) AS n FROM ev WHERE classification = 'PUBLIC_ANALYTICAL' GROUP BY 1",
)(lambda c: E.visible(bundle(c), "PUBLIC_ANALYTICAL").groupBy("evidence_type").agg(F.count("*").alias("n")))

# L: decisions
_ONTOLOGY = (
    ("product_category", ["category"], "promote", "promote {target}", "MODERATE", "MEDIUM", "HIGH", ["revenue", "orders"], ["budget", "inventory"]),
    ("product_category", None, "reprice", "reprice {target}", "STRONG", "LOW", "HIGH", ["revenue", "aov"], ["budget", "decision_rights"]),
    (
        "state",
        ["customer_state"],
        "ship_faster",
        "faster delivery to {target}",
        "WEAK",
        "HIGH",
        "MEDIUM",
        ["avg_delivery_days", "revenue"],
        ["operational_capacity", "geography"],
    ),
)
_SCORE = {"HIGH": 0.9, "MEDIUM": 0.6, "LOW": 0.3}


def signals(c):
    rows = segments(c)
    return rows.select(
        F.concat_ws(":", "segment_type", "segment_value").alias("signal_id"), F.col("segment_type").alias("driver"), F.col("segment_value").alias("target"), F.lit("revenue").alias("metric"), F.when(F.col("previous") > 0, F.col("absolute_change").cast("double")).alias("effect"), F.col("sample_size").alias("population"),
        L.scored("confidence", _SCORE).alias("signal_confidence"), F.col("confidence").alias("data_quality"), F.least(F.lit(1.0), F.col("history_months") / 6).alias("history"),
    )


def actions(c):
    ontology = c.spark.createDataFrame(
        _ONTOLOGY,
        "driver string, aliases array<string>, action_type string, template string, link string, effort string, controllability string, kpis array<string>, relevant array<string>",
    )
    out = L.with_impact(L.candidates(signals(c), ontology)).withColumn("action_id", F.concat_ws(":", "signal_id", "action_type"))
    return out.selectExpr(
        "*",
        "population % 50 AS budget_pct",
        "population % 120 AS utilization_pct",
        "population AS units",
        "CASE WHEN population % 5 > 0 THEN population % 7 > 0 END AS coverage",
        "population % 3 > 0 AS owner_allowed",
    )


_ACT = f"""{_seg_sql()}, sg AS (SELECT segment_type || ':' || segment_value AS signal_id, segment_type AS driver, segment_value AS target, CASE WHEN previous > 0 THEN absolute_change END AS effect, sample_size AS population, CASE confidence WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.6 WHEN 'LOW' THEN 0.3 END::DOUBLE AS signal_confidence,
    CASE confidence WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.6 ELSE 0.3 END AS dq, least(1.0, history_months / 6::DOUBLE) AS history FROM seg),
    ont AS (SELECT * FROM (VALUES ('product_category', 'promote', 'promote ', 0.6, 0.5, 0.9, ['revenue', 'orders'], ['budget', 'inventory']), ('product_category', 'reprice', 'reprice ', 0.9, 0.2, 0.9, ['revenue', 'aov'], ['budget', 'decision_rights']),
      ('customer_state', 'ship_faster', 'faster delivery to ', 0.25, 0.85, 0.55, ['avg_delivery_days', 'revenue'], ['operational_capacity', 'geography'])) t(driver, action_type, template, link, effort, control, kpis, relevant)),
    act AS (SELECT *, abs(coalesce(estimated_effect, 0)) * confidence * control / greatest(effort, 0.05) AS priority FROM (SELECT signal_id, signal_id || ':' || action_type AS action_id, template || target AS action, effect, population, effect * population * signal_confidence AS estimated_effect, CASE WHEN effect IS NULL THEN 'effect' ELSE '' END AS missing,
      least(1, greatest(0, 0.35 * signal_confidence + 0.25 * dq + 0.25 * history + 0.15 * link))::DOUBLE AS confidence, control::DOUBLE AS control, effort::DOUBLE AS effort, kpis, relevant FROM sg JOIN ont USING (driver))),
    con AS (SELECT action_id, unnest(relevant) AS constraint_name, population AS p FROM act), cs AS (SELECT action_id, constraint_name, CASE constraint_name WHEN 'budget' THEN CASE WHEN p % 50 <= 0 THEN 'BLOCKED' WHEN p % 50 < 20 THEN 'WARNING' ELSE 'PASS' END
      WHEN 'operational_capacity' THEN CASE WHEN p % 120 >= 100 THEN 'BLOCKED' WHEN p % 120 >= 85 THEN 'WARNING' ELSE 'PASS' END WHEN 'inventory' THEN CASE WHEN p <= 0 THEN 'BLOCKED' WHEN p < 100 THEN 'WARNING' ELSE 'PASS' END
      WHEN 'geography' THEN CASE WHEN p % 5 = 0 THEN 'WARNING' WHEN p % 7 > 0 THEN 'PASS' ELSE 'BLOCKED' END ELSE CASE WHEN p % 3 > 0 THEN 'PASS' ELSE 'BLOCKED' END END AS status FROM con),
    rk AS (SELECT signal_id, action_id, action, round(priority, 2) AS priority, w, row_number() OVER (PARTITION BY signal_id, w ORDER BY round(priority, 2) DESC, action_id) AS n FROM act JOIN (SELECT action_id, max(CASE status WHEN 'BLOCKED' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS w FROM cs GROUP BY 1) USING (action_id)),
    ranked AS (SELECT signal_id, action_id, priority, CASE WHEN w < 2 THEN n END AS place, CASE WHEN w = 2 THEN 'BLOCKED' WHEN w = 1 THEN 'CONDITIONAL' WHEN n = 1 THEN 'TOP' ELSE 'RANKED' END AS tier FROM rk)"""


def ranked(c):
    a = actions(c)
    return L.rank_actions(a, L.constraints(a))


query("l1_candidates", f"WITH {_ACT} SELECT action_id, action FROM act")(lambda c: actions(c).select("action_id", "action"))
_UNIT = "CASE WHEN signal_id LIKE 'customer_state:%' THEN 'orders' ELSE 'currency' END"
query("l2_expected_impact", f"""WITH {_ACT}, aov AS (SELECT (sum(price) / count(DISTINCT order_id))::DOUBLE AS aov FROM kpi_items) SELECT action_id, {_UNIT} AS unit, round(estimated_effect, 2) AS estimated_effect, missing,
    round(estimated_effect * CASE WHEN {_UNIT} = 'currency' THEN 1 ELSE aov END, 2) AS revenue_impact FROM act, aov""")(lambda c: impact(c))  # fmt: skip


def impact(c):
    """Expected effects, and what they are in revenue: those counted in orders by the average order value."""
    value = _items(c).agg((F.sum("price").cast("double") / F.count_distinct("order_id")).alias("aov"))
    rows = L.with_revenue(actions(c).withColumn("unit", F.expr(_UNIT)), value)
    return rows.select("action_id", "unit", F.round("estimated_effect", 2).alias("estimated_effect"), "missing", F.round("revenue_impact", 2).alias("revenue_impact"))


query("l3_constraints", f"WITH {_ACT} SELECT * FROM cs")(lambda c: L.constraints(actions(c)))
query(
    "l4_confidence",
    f"WITH {_ACT} SELECT action_id, round(confidence, 6) AS confidence FROM act",
)(lambda c: actions(c).select("action_id", F.round("confidence", 6).alias("confidence")))
query(
    "l5_priority",
    f"WITH {_ACT} SELECT action_id, control, effort AS effort_score, round(priority, 2) AS priority FROM act",
)(lambda c: actions(c).select("action_id", "control", "effort_score", F.round("priority", 2).alias("priority")))
query("l6_ranked_actions", f"WITH {_ACT} SELECT * FROM ranked")(ranked)
query(
    "l7_monitoring",
    f"WITH {_ACT}, m AS (SELECT action_id, estimated_effect AS e, unnest(kpis) AS kpi FROM act) SELECT action_id, kpi, CASE "
    "WHEN kpi IN ('revenue', 'orders', 'aov') THEN 'increase' ELSE 'decrease' END AS direction, round(CASE "
    "WHEN kpi = 'revenue' THEN e END, 4) AS expected_effect, round(CASE WHEN kpi = 'revenue' THEN e / 2 END, 4) AS warning_threshold "
    "FROM m",
)(lambda c: L.monitoring(actions(c), ("revenue", "orders", "aov")))
query(
    "l8_driver_signals",
    f"WITH {_ACT} SELECT signal_id, effect, population, signal_confidence FROM sg",
)(lambda c: signals(c).select("signal_id", "effect", "population", "signal_confidence"))
query("l29_narrative", f"WITH {_ACT} SELECT action_id, CASE tier WHEN 'BLOCKED' THEN 'Not now: ' WHEN 'CONDITIONAL' THEN 'If conditions allow: ' ELSE 'Do: ' END || action || coalesce(' (place ' || place || ')', '') AS narrative FROM ranked JOIN act USING (action_id)")(
    lambda c: (lambda a: L.rank_actions(a, L.constraints(a)).join(a.select("action_id", "action"), "action_id"))(actions(c)).select(
        "action_id",
        F.concat(
            F.when(F.col("tier") == "BLOCKED", "Not now: ").when(F.col("tier") == "CONDITIONAL", "If conditions allow: ").otherwise("Do: "),
            "action",
            F.coalesce(F.concat(F.lit(" (place "), F.col("place").cast("string"), F.lit(")")), F.lit("")),
        ).alias("narrative"),
    )
)

# L: claims about segments; every 7th number is altered, every 11th citation unknown, every 5th wording causal.
_CLAIM = f"""{_seg_sql()}, nr AS (SELECT segment_type || ':' || segment_value AS claim_id, row_number() OVER (PARTITION BY segment_type ORDER BY abs(absolute_change) DESC, segment_value) AS n, floor(abs(absolute_change))::BIGINT AS v, floor(abs(share_of_total))::BIGINT AS p FROM seg),
    clm AS (SELECT claim_id, ['FACT', 'ASSOCIATION', 'ANALYTICAL_FINDING'][1 + n % 3] AS claim_type, CASE WHEN n % 11 = 0 THEN 'ev_missing' ELSE 'ev_seg_' || substr(sha256('SEGMENT_CONTRIBUTION|' || claim_id), 1, 16) END AS cited,
      CASE WHEN n % 13 = 0 THEN 'Revenue moved' ELSE 'Revenue moved by R$ ' || format('{{:,}}', (v + CASE WHEN n % 7 = 0 THEN 1000000 ELSE 0 END)::BIGINT) || ', ' || p || '% of the change, in {_NOW}' END || CASE WHEN n % 5 = 0 THEN ', caused by demand' ELSE '' END AS text, v, p, CASE WHEN n % 17 = 0 THEN claim_id || ':teleport' WHEN n % 4 = 0 THEN claim_id || ':promote' END AS recommendation FROM nr),
    raw AS (SELECT claim_id, generate_subscripts(r, 1) - 1 AS position, unnest(r) AS raw FROM (SELECT claim_id, regexp_extract_all(text, '[-+]?R?\\$?\\s?[0-9][0-9,]*\\.?[0-9]*[KkMm]?\\s?%?') AS r FROM clm)),
    num AS (SELECT * FROM (SELECT claim_id, position::INTEGER AS position, regexp_replace(raw, '[^0-9.+-]', '', 'g')::DOUBLE AS value, CASE WHEN contains(raw, '%') THEN 'percent' WHEN contains(raw, 'R$') THEN 'BRL' WHEN contains(raw, '$') THEN 'USD' ELSE 'unitless' END AS unit FROM raw) WHERE NOT (unit = 'unitless' AND (value BETWEEN 1900 AND 2100 OR abs(value) < 20))),
    alw AS (SELECT claim_id, 'BRL' AS unit, v::DOUBLE AS known FROM clm UNION ALL SELECT claim_id, 'percent', p FROM clm),
    mat AS (SELECT claim_id, position, value, unit, coalesce(bool_or(abs(value - known) <= greatest(0.0005 * abs(known), 0.01)), false) AS matched, first(known ORDER BY abs(value - known), known) AS nearest FROM num LEFT JOIN alw USING (claim_id, unit) GROUP BY ALL),
    lng AS (SELECT claim_id, regexp_matches(text, '{E.CAUSAL}') AS violates FROM clm)"""
_VERIFIED = f"""{_ACT}, {_CLAIM.removeprefix(_seg_sql() + ", ")},
    res AS (SELECT claim_id, CASE WHEN cited = 'ev_missing' THEN 'unknown_evidence' WHEN recommendation NOT IN (SELECT action_id FROM act) THEN 'unsupported_recommendation' WHEN violates THEN 'language' WHEN wrong > 0 THEN 'number' WHEN numbers IS NULL AND claim_type IN ('FACT', 'ANALYTICAL_FINDING') THEN 'decorative_citation' END AS reason
      FROM clm JOIN lng USING (claim_id) LEFT JOIN (SELECT claim_id, count(*) AS numbers, count(*) FILTER (NOT matched) AS wrong FROM mat GROUP BY 1) USING (claim_id))"""


def claims(c):
    n = D.ranked(segments(c)).select(
        F.concat_ws(":", "segment_type", "segment_value").alias("claim_id"),
        F.col("rank").alias("n"),
        F.floor(F.abs("absolute_change").cast("double")).alias("v"),
        F.floor(F.abs("share_of_total")).alias("p"),
    )
    said = F.concat(
        F.lit("Revenue moved by R$ "),
        F.format_number(F.col("v") + F.when(F.col("n") % 7 == 0, 1_000_000).otherwise(0), 0),
        F.lit(", "),
        F.col("p").cast("string"),
        F.lit(f"% of the change, in {_NOW}"),
    )
    text = F.concat(F.when(F.col("n") % 13 == 0, "Revenue moved").otherwise(said), F.when(F.col("n") % 5 == 0, ", caused by demand").otherwise(""))
    cited = F.when(F.col("n") % 11 == 0, "ev_missing").otherwise(E.evidence_id("seg", F.lit("SEGMENT_CONTRIBUTION"), F.col("claim_id")))
    return n.select(
        "claim_id",
        F.element_at(F.array(F.lit("FACT"), F.lit("ASSOCIATION"), F.lit("ANALYTICAL_FINDING")), F.col("n") % 3 + 1).alias("claim_type"),
        F.array(cited).alias("cited"),
        text.alias("text"),
        "v",
        "p",
        F.when(F.col("n") % 17 == 0, F.concat("claim_id", F.lit(":teleport"))).when(F.col("n") % 4 == 0, F.concat("claim_id", F.lit(":promote"))).alias("recommendation"),
    )


def matched(c):
    rows = claims(c)
    allowed = rows.select("claim_id", F.expr("stack(2, 'BRL', double(v), 'percent', double(p)) AS (unit, known)"))
    return L.match_numbers(L.numeric_claims(rows), allowed)


def verified(c):
    known = segment_rows(c).select("evidence_id", F.lit("ANALYTICAL_FINDING").alias("claim_type"), "value")
    return L.verify_claims(claims(c), known, matched(c), actions(c).select(F.col("action_id").alias("recommendation")))


query("l9_numeric_claims", f"WITH {_CLAIM} SELECT * FROM num")(lambda c: L.numeric_claims(claims(c)))
query("l11_number_violations", f"WITH {_CLAIM} SELECT claim_id, value FROM num n WHERE NOT EXISTS (SELECT 1 FROM alw a WHERE a.claim_id = n.claim_id AND a.known = n.value)")(
    lambda c: (
        lambda r: L.numeric_claims(r).select("claim_id", "value").join(
            r.select("claim_id", F.explode(F.array(F.col("v").cast("double"), F.col("p").cast("double"))).alias("value")),
            ["claim_id", "value"],
            "left_anti",
        )
    )(claims(c))
)
query("l12_language_gate", f"WITH {_CLAIM} SELECT * FROM lng")(
    lambda c: claims(c).select("claim_id", L.language_violation(F.col("text"), F.col("claim_type")).alias("violates"))
)
query(
    "l13_verified_claims",
    f"WITH {_VERIFIED} SELECT claim_id, CASE WHEN reason IS NULL THEN 'APPROVED' ELSE 'REJECTED' END AS status, reason FROM res",
)(verified)
query("l13_stories", f"WITH {_VERIFIED} SELECT string_split(claim_id, ':')[1] AS story, count(*) AS claims_checked, count(reason) AS claims_rejected, CASE WHEN count(reason) = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM res GROUP BY 1")(
    lambda c: L.verify_stories(verified(c), claims(c).select("claim_id", F.split("claim_id", ":")[0].alias("story")))
)
_TYPES = {
    "KPI_OBSERVATION": "FACT",
    "KPI_MOVEMENT": "FACT",
    "DRIVER_CONTRIBUTION": "ANALYTICAL_FINDING",
    "SEGMENT_CONTRIBUTION": "ANALYTICAL_FINDING",
    "ANOMALY_SIGNAL": "ASSOCIATION",
    "STATISTICAL_RESULT": "ASSOCIATION",
}
query("l14_claim_types", f"WITH {_BUNDLE} SELECT evidence_id, CASE evidence_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END AS claim_type FROM ev")(lambda c: bundle(c).select("evidence_id", F.create_map(*(F.lit(x) for p in _TYPES.items() for x in p))[F.col("evidence_type")].alias("claim_type")))
query("l15_persona_order", f"""WITH {_BUNDLE}, per AS (SELECT * FROM (VALUES ('executive', 'revenue', ['STATISTICAL_RESULT', 'KPI_OBSERVATION']), ('operations', 'avg_delivery_days', ['DRIVER_CONTRIBUTION', 'KPI_OBSERVATION'])) t(persona, preferred, excluded)),
    o AS (SELECT persona, evidence_id, row_number() OVER (PARTITION BY persona ORDER BY (subject <> preferred)::INTEGER, evidence_type, evidence_id)::INTEGER AS position FROM ev, per WHERE NOT list_contains(excluded, evidence_type)) SELECT *, ((position - 1) // 5)::INTEGER AS section FROM o""")(
    lambda c: L.persona_order(bundle(c), c.spark.createDataFrame([("executive", "revenue", ["STATISTICAL_RESULT", "KPI_OBSERVATION"]), ("operations", "avg_delivery_days", ["DRIVER_CONTRIBUTION", "KPI_OBSERVATION"])], "persona string, preferred string, excluded array<string>"), 5)
)

# L: feedback from the event log
query("l19_conflicts", "SELECT user_id, before AS kept_a, event_id AS kept_b, 'CONTESTED' AS status FROM (SELECT *, lag(event_id) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error' AND was = 'purchase'")(
    lambda c: (
        lambda w: c.raw("events").withColumn("kept_a", F.lag("event_id").over(w)).withColumn("was", F.lag("event_type").over(w)).where("event_type = 'error' AND was = 'purchase'").select(
            "user_id",
            "kept_a",
            F.col("event_id").alias("kept_b"),
            F.lit("CONTESTED").alias("status"),
        )
    )(Window.partitionBy("user_id").orderBy("ts", "event_id"))
)
#: Comments made of two sentences each, in the order of the log: the given tables hold no comments of users.
_SAID = (
    "The KPI definition is old", "Rows were excluded", "Refunded orders count", "Poor data quality", "A driver is missing", "The weather caused it", "Where is the evidence",
    "Low confidence", "I recommend a test", "No capacity left", "There was a campaign", "It was a holiday", "Better wording", "A long narrative", "All fine", "Thank you",
)
_RATED = ("MISSING_DRIVER", "WRONG_CONFIDENCE", "HELPFUL", "WRONG_RECOMMENDATION", "MISLEADING")
_COMMENT = f"{list(_SAID)}[event_id % {len(_SAID)} + 1] || '. ' || {list(_SAID)}[(event_id // {len(_SAID)}) % {len(_SAID)} + 1]"
_FOUND = ", ".join([f"CASE WHEN rating = '{r}' THEN '{k}' END" for r, k in L.RATINGS.items()] + [f"CASE WHEN contains(lower(comment), '{w}') THEN '{k}' END" for w, k in L.KEYWORDS])
query("l20_feedback_categories", f"""SELECT event_id, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS categories FROM (
    SELECT event_id, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS found FROM (SELECT event_id, {list(_RATED)}[event_id % {len(_RATED)} + 1] AS rating, {_COMMENT} AS comment FROM events))""")(
    lambda c: comments(c).select("event_id", F.array_join(L.categories(F.col("rating"), F.col("comment")), ",").alias("categories"))
)


def comments(c):
    """event_id, rating and comment."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    n = F.col("event_id")
    return c.raw("events").select(
        "event_id",
        pick(_RATED, n).alias("rating"),
        F.concat(pick(_SAID, n), F.lit(". "), pick(_SAID, F.floor(n / len(_SAID)))).alias("comment"),
    )


query(
    "l21_next_version",
    "SELECT 'v' || (max(regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT) + 1) AS next FROM customer",
)(lambda c: L.next_version(c.raw("customer"), "c_name"))
query("l21_promoted_cases", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")(
    lambda c: c.raw("events").where("event_type = 'signup'").select("user_id").distinct().join(
        c.raw("events").where("event_type = 'purchase'"),
        "user_id",
        "left_semi",
    )
)


def cases(c):
    """A case for each customer; those that no event names have no output."""
    return c.raw("customer").selectExpr(
        "c_custkey AS case_id", "CASE WHEN c_custkey % 2 = 0 THEN array('error') ELSE CAST(array() AS array<string>) END AS forbidden", "array('purchase') AS expected",
        "CASE WHEN c_custkey % 10 = 1 THEN map('action', 'promote', 'target', 'click') WHEN c_custkey % 5 > 0 THEN map('action', 'promote') END AS recommendation", "CASE WHEN c_custkey % 3 > 0 THEN 'click' END AS driver", "CASE WHEN c_custkey % 4 > 0 THEN 0.2D END AS low", "CASE WHEN c_custkey % 4 > 0 THEN 0.6D END AS high",
    )


#: Runs over all events: what a run claims of an event type (rows n, sum of values v, share of the user's rows s).
_RUNS = (("true", "n"), ("s >= 0.15", "v"))


def outputs(c, run: int):
    """The baseline (0) claims every event type of a user and names the commonest; the candidate (1) only frequent ones, and the costliest."""
    claimed, by = _RUNS[run]
    each = c.raw("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    each = each.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).withColumn("v", F.round("v", 4))
    claims = F.collect_set(F.when(F.expr(claimed), F.col("event_type"))).alias("claims")
    out = each.groupBy(F.col("user_id").alias("case_id")).agg(
        claims,
        F.max_by("event_type", F.struct(by, "event_type")).alias("driver_out"),
        (F.sum("v") / F.sum("n") / 200).alias("score"),
    )
    return out.withColumn("recommendation_out", F.create_map(F.lit("action"), F.when(F.col("driver_out") == "error", "fix").otherwise("promote"), F.lit("target"), F.col("driver_out")))


def _res(run: int) -> str:
    claimed, by = _RUNS[run]
    return f"""SELECT case_id, CASE WHEN case_id % 2 = 0 THEN coalesce(NOT list_contains(claims, 'error'), false) END AS forbidden_absent, coalesce(list_contains(claims, 'purchase'), false) AS expected_present,
      CASE WHEN case_id % 3 > 0 THEN coalesce(driver_out = 'click', false) END AS driver_right, CASE WHEN case_id % 4 > 0 THEN coalesce(score BETWEEN 0.2 AND 0.6, false) END AS confidence_in_range,
      CASE WHEN case_id % 10 = 1 THEN coalesce(driver_out = 'click', false) WHEN case_id % 5 > 0 THEN coalesce(driver_out <> 'error', false) END AS recommendation_right
      FROM (SELECT c_custkey AS case_id FROM customer) LEFT JOIN (SELECT user_id AS case_id, coalesce(list(event_type) FILTER ({claimed}), []) AS claims, first(event_type ORDER BY {by} DESC, event_type DESC) AS driver_out, sum(v) / sum(n) / 200 AS score
      FROM (SELECT user_id, event_type, n, round(v, 4) AS v, n / sum(n) OVER (PARTITION BY user_id) AS s FROM (SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)) GROUP BY 1) USING (case_id)"""


def _met(run: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS metric, round(avg({d}::INTEGER), 6) AS value, count({d}) AS declared FROM ({_res(run)})" for d in L.DIMENSIONS
    ) + f" UNION ALL SELECT 'unsupported_claim_rate', round(1 - avg(forbidden_absent::INTEGER), 6), count(forbidden_absent) FROM ({_res(run)})"


_MIN_OF = (("forbidden_absent", 0.5), ("expected_present", 0.9), ("driver_right", 0.2), ("confidence_in_range", 0.8), ("recommendation_right", 0.5), ("unsupported_claim_rate", 0.4))
query("l22_case_evaluation", _res(0))(lambda c: L.evaluate_cases(cases(c), outputs(c, 0)))
query("l23_evaluation_metrics", _met(0))(lambda c: L.evaluation_metrics(L.evaluate_cases(cases(c), outputs(c, 0))))
query(
    "l24_baseline_candidate",
    "SELECT metric, b.value AS baseline, k.value AS candidate, round(k.value - b.value, 6) AS delta, CASE "
    "WHEN k.value = b.value THEN 'SAME' "
    f"WHEN (k.value > b.value) = (metric <> 'unsupported_claim_rate') THEN 'IMPROVED' ELSE 'REGRESSED' END AS change FROM ({_met(0)}) b "
    f"JOIN ({_met(1)}) k USING (metric)",
)(lambda c: L.compare_metrics(*(L.evaluation_metrics(L.evaluate_cases(cases(c), outputs(c, r))) for r in (0, 1))))
query("l25_regression_run", f"SELECT passed, count(*) AS n FROM (SELECT {' AND '.join(f'coalesce({d}, true)' for d in L.DIMENSIONS)} AS passed FROM ({_res(0)})) GROUP BY 1")(
    lambda c: L.evaluate_cases(cases(c), outputs(c, 0)).select(
        reduce(lambda a, b: a & b, (F.coalesce(d, F.lit(True)) for d in L.DIMENSIONS)).alias("passed")
    ).groupBy("passed").agg(F.count("*").alias("n"))
)
query(
    "l30_threshold_gate",
    "SELECT metric, value, threshold::DOUBLE AS threshold, CASE "
    f"WHEN metric = 'unsupported_claim_rate' THEN value <= threshold ELSE value >= threshold END AS passed FROM ({_met(0)}) "
    f"JOIN (VALUES {', '.join(map(str, _MIN_OF))}) t(metric, threshold) USING (metric)",
)(
    lambda c: L.threshold_gate(
        L.evaluation_metrics(L.evaluate_cases(cases(c), outputs(c, 0))),
        c.spark.createDataFrame(_MIN_OF, "metric string, threshold double"),
    )
)
