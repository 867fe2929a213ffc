"""Queries of group K: slices, trends, eligibility, methods, contradiction and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import causal as C
from ..operators import kpi as K
from .analytics import _NOW, _T, _items, _seg_sql, _timed, segments
from .movement import registry
from .sql import Registry

query = Registry()
_DIMS = ("product_category", "customer_state", "seller_state")
query(
    "k1_group_slices",
    "SELECT *, sum(value) OVER () - value AS rest_value, (sum(sample) OVER () - sample)::BIGINT AS rest_sample "
    f"FROM (SELECT customer_state, sum(price)::DECIMAL(18,4) AS value, count(*) AS sample FROM kpi_items WHERE month = '{_NOW}' "
    "GROUP BY 1)",
    "value rest_value",
)(lambda c: C.group_slices(_items(c, "customer_state").where(F.col("month") == _NOW), "customer_state"))
_PRE = "SELECT customer_state, t, sum(price)::DOUBLE AS value FROM (SELECT customer_state, price, date_diff('month', DATE '1995-01-01', (month || '-01')::DATE)::DOUBLE AS t FROM kpi_items WHERE month < '1998-01') GROUP BY 1, 2"
query("k3_parallel_trends", f"""WITH s AS ({_PRE}), b AS (SELECT s.*, sum(value) OVER (PARTITION BY t) - value AS rest FROM s), f AS (SELECT customer_state, count(*) AS periods, regr_slope(value, t) AS s, regr_slope(rest, t) AS r FROM b GROUP BY 1)
    SELECT customer_state, periods, round(s, 4) AS slope, round(r, 4) AS rest_slope, round(abs(s - r) / greatest(abs(r), 1e-9), 6) AS ratio, coalesce(periods >= 2 AND abs(s - r) / greatest(abs(r), 1e-9) <= 0.5, false) AS parallel FROM f""")(
    lambda c: C.parallel_trends(_items(c, "customer_state").where("month < '1998-01'").withColumn("t", F.months_between(F.to_date(F.concat("month", F.lit("-01"))), F.lit("1995-01-01").cast("date"))).groupBy("customer_state", "t").agg(F.sum("price").cast("double").alias("value")), "customer_state")
)
query("k6_autocorrelation", f"""WITH x AS ({_T}), f AS (SELECT *, value - (regr_intercept(value, t) OVER w + regr_slope(value, t) OVER w * t) AS e FROM x WINDOW w AS (PARTITION BY series_id, t > 40)), d AS (SELECT *, e - avg(e) OVER (PARTITION BY series_id) AS d FROM f),
    p AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY t) AS p FROM d), s AS (SELECT series_id, count(e) AS n, sum(d * p) AS a, sum(d * d) AS b FROM p GROUP BY 1)
    SELECT series_id, n, round(CASE WHEN n >= 3 AND b > 1e-9 THEN a / b END, 4) AS r1, coalesce(CASE WHEN n >= 3 AND b > 1e-9 THEN abs(a / b) <= 0.5 END, false) AS passed FROM s""")(lambda c: C.lag1_autocorrelation(_timed(c), 40))
query(
    "k7_sufficient_history",
    "SELECT series_id, count(*) FILTER (t <= 40) AS pre, count(*) FILTER (t > 40) AS post, count(*) FILTER (t <= 40) >= 12 AND count(*) FILTER (t > 40) >= 3 AS sufficient " f"FROM ({_T}) GROUP BY 1",
)(
    lambda c: _timed(c).groupBy("series_id").agg(
        F.count_if(F.col("t") <= 40).alias("pre"),
        F.count_if(F.col("t") > 40).alias("post"),
    ).withColumn("sufficient", (F.col("pre") >= 12) & (F.col("post") >= 3))
)

# Hypotheses: every category as a treated group, and every year's spring as an event in time.
_HYP = f"""g AS (SELECT coalesce(product_category, 'none') AS k, count(*) FILTER (month = '{_NOW}') AS n, min(month) AS first, max(month) AS last, count(DISTINCT month) FILTER (month < '{_NOW}') AS pre FROM kpi_items GROUP BY 1),
    y AS (SELECT substr(month, 1, 4) AS year, count(*) FILTER (month LIKE '%-03') AS t, count(*) FILTER (month LIKE '%-04') AS n FROM kpi_items GROUP BY 1),
    lim AS (SELECT min(month) AS a, max(month) AS b FROM kpi_items),
    hyp AS (SELECT 'group:' || k AS hypothesis_id, 'revenue' AS outcome, 'category' AS treatment, 'product_category' AS dimension, 'all_other' AS control_group, 'product_category' AS unit, 'PVM' AS proposed, pre AS pre_months, 1::BIGINT AS post_months,
      '{_NOW}' AS treatment_end, '{_NOW}' AS outcome_start, n AS treated_rows, sum(n) OVER ()::BIGINT - n AS control_rows, n AS outcome_rows, 20 AS minimum_rows, NULL::DOUBLE AS coverage, 0 AS events, first >= a AND last <= b AS in_window FROM g, lim
    UNION ALL SELECT 'time:' || year, 'revenue', 'orders', NULL, NULL, 'month', NULL, greatest(date_diff('month', (a || '-01')::DATE, (year || '-03-01')::DATE), 0), greatest(date_diff('month', (year || '-03-01')::DATE, (b || '-01')::DATE), 0),
      year || '-03', year || '-04', t, NULL, n, 20, 100.0, (year = '1998')::INTEGER, year || '-03' >= a AND year || '-04' <= b FROM y, lim)"""
_OK = "CASE WHEN coalesce({}, false) THEN 'PASS' ELSE '{}' END"


def _lv(n, hard, soft):
    return f"CASE WHEN {n} < {hard} THEN 'HARD_FAIL' WHEN {n} < {soft} THEN 'SOFT_FAIL' ELSE 'PASS' END"


_CHK = (
    _OK.format("CASE WHEN dimension IS NOT NULL THEN dimension IN " + str(_DIMS) + " ELSE treatment IN " + str(K.KPIS) + " END", "HARD_FAIL"), _OK.format("outcome IN " + str(K.KPIS), "HARD_FAIL"), _OK.format("dimension IS NULL AND treatment_end <= outcome_start", "HARD_FAIL"),
    _lv("coalesce(pre_months, 0)", 3, 12), _lv("coalesce(post_months, 0)", 1, 3), _OK.format("treated_rows >= 1", "HARD_FAIL"), "CASE WHEN dimension IS NULL AND control_group IS NULL THEN 'NOT_APPLICABLE' WHEN control_group IS NOT NULL AND control_rows >= 1 THEN 'PASS' ELSE 'HARD_FAIL' END",
    _lv("coalesce(outcome_rows, 0)", "minimum_rows / 2", "minimum_rows"), f"CASE WHEN coverage IS NULL THEN 'SOFT_FAIL' ELSE {_lv('coverage', 47.5, 95)} END", _OK.format("events = 0", "SOFT_FAIL"),
    _OK.format("unit IN " + str(("order", "review", "month", "day", "week", *_DIMS)), "HARD_FAIL"), _OK.format("in_window", "HARD_FAIL"),
)
_CHECKS = f"{_HYP}, chk AS (SELECT hypothesis_id, unnest([" + ", ".join(f"{{position: {i}, check_name: '{n}', status: {s}}}" for i, (n, s) in enumerate(zip(C.CHECKS, _CHK, strict=True))) + "]) AS x FROM hyp), chks AS (SELECT hypothesis_id, x.position, x.check_name, x.status FROM chk)"
_VERDICT = f"""{_CHECKS}, ver AS (SELECT hypothesis_id, CASE WHEN h = ['treatment_precedes_outcome'] THEN 'CAUSAL_INELIGIBLE' WHEN len(h) > 0 THEN 'INELIGIBLE' WHEN soft > 0 THEN 'PARTIALLY_ELIGIBLE' ELSE 'ELIGIBLE' END AS verdict, array_to_string(h, ',') AS hard_fails, soft
    FROM (SELECT hypothesis_id, coalesce(list_sort(list(check_name) FILTER (status = 'HARD_FAIL')), []) AS h, count(*) FILTER (status = 'SOFT_FAIL') AS soft FROM chks GROUP BY 1))"""
_METHOD = f"""{_VERDICT}, met AS (SELECT hypothesis_id, verdict, CASE WHEN verdict = 'CAUSAL_INELIGIBLE' THEN 'NONE' WHEN outcome = 'revenue' AND proposed = 'PVM' THEN 'PVM' WHEN verdict = 'INELIGIBLE' THEN 'NONE'
    WHEN dimension IS NOT NULL AND control_group IS NOT NULL AND NOT contains(hard_fails, 'sufficient_pre') AND NOT contains(hard_fails, 'precedes') THEN 'DIFFERENCE_IN_DIFFERENCES' WHEN dimension IS NULL AND NOT contains(hard_fails, 'sufficient_p') THEN 'INTERRUPTED_TIME_SERIES'
    WHEN proposed = 'EXPERIMENTAL_RESULT' THEN 'EXPERIMENTAL_RESULT' ELSE 'DESCRIPTIVE_ASSOCIATION' END AS method FROM hyp JOIN ver USING (hypothesis_id))"""


def hypotheses(c):
    items = _items(c, "product_category").select(F.coalesce("product_category", F.lit("none")).alias("k"), "month")
    per = items.groupBy("k", "month").agg(F.count("*").alias("n"))
    limits = F.broadcast(per.agg(F.min("month").alias("a"), F.max("month").alias("b")))
    groups = per.groupBy("k").agg(
        F.coalesce(F.sum(F.when(F.col("month") == _NOW, F.col("n"))), F.lit(0)).alias("n"),
        F.min("month").alias("first"),
        F.max("month").alias("last"),
        F.count_if(F.col("month") < _NOW).alias("pre"),
    )
    treated = groups.crossJoin(limits).withColumn("rest", F.sum("n").over(Window.partitionBy(F.lit(1))) - F.col("n")).selectExpr(
        "'group:' || k AS hypothesis_id", "'revenue' AS outcome", "'category' AS treatment", "'product_category' AS dimension", "'all_other' AS control_group", "'product_category' AS unit", "'PVM' AS proposed", "pre AS pre_months", "1L AS post_months",
        f"'{_NOW}' AS treatment_end", f"'{_NOW}' AS outcome_start", "n AS treated_rows", "rest AS control_rows", "n AS outcome_rows", "20 AS minimum_rows", "CAST(NULL AS double) AS coverage", "0 AS events", "first >= a AND last <= b AS in_window",
    )
    event = F.broadcast(registry(c).agg(F.max("event_month").alias("event")))
    years = per.groupBy(F.substring("month", 1, 4).alias("year")).agg(
        F.coalesce(F.sum(F.when(F.col("month").endswith("-03"), F.col("n"))), F.lit(0)).alias("t"),
        F.coalesce(F.sum(F.when(F.col("month").endswith("-04"), F.col("n"))), F.lit(0)).alias("n"),
    )
    timed = years.crossJoin(limits).crossJoin(event).selectExpr(
        "'time:' || year", "'revenue'", "'orders'", "CAST(NULL AS string)", "CAST(NULL AS string)", "'month'", "CAST(NULL AS string)", "CAST(greatest(months_between(to_date(year || '-03-01'), to_date(a || '-01')), 0) AS long)", "CAST(greatest(months_between(to_date(b || '-01'), to_date(year || '-03-01')), 0) AS long)",
        "year || '-03'", "year || '-04'", "t", "CAST(NULL AS long)", "n", "20", "100.0D", "int(substr(event, 1, 4) = year)", "year || '-03' >= a AND year || '-04' <= b",
    )
    return treated.union(timed)


def checks(c):
    return C.eligibility_checks(hypotheses(c), K.KPIS, _DIMS)


def methods(c):
    h = hypotheses(c)
    return C.select_method(h, C.eligibility_verdict(C.eligibility_checks(h, K.KPIS, _DIMS)))


query(
    "k8_confounders",
    f"WITH {_HYP} SELECT hypothesis_id, events, CASE WHEN events > 0 THEN 'spike_1998_11' END AS confounder FROM hyp",
)(lambda c: hypotheses(c).selectExpr("hypothesis_id", "events", "CASE WHEN events > 0 THEN 'spike_1998_11' END AS confounder"))
query("k9_eligibility_checks", f"WITH {_CHECKS} SELECT * FROM chks")(checks)
query("k10_eligibility_verdict", f"WITH {_VERDICT} SELECT * FROM ver")(lambda c: C.eligibility_verdict(checks(c)))
query("k11_method", f"WITH {_METHOD} SELECT * FROM met")(methods)
_STATUS = f"""{_METHOD}, tr AS (SELECT *, hypothesis_id LIKE '%9' AS passed, method IN ('DIFFERENCE_IN_DIFFERENCES', 'INTERRUPTED_TIME_SERIES') AS quasi FROM met),
    te AS (SELECT hypothesis_id, verdict, method, quasi AND passed AND verdict = 'ELIGIBLE' AS claim_allowed, CASE WHEN quasi AND passed AND verdict = 'ELIGIBLE' THEN 'T3_QUASI_EXPERIMENTAL' WHEN method = 'PVM' OR quasi AND passed THEN 'T2_ARITHMETIC' ELSE 'T1_DESCRIPTIVE' END AS evidence_tier FROM tr),
    st AS (SELECT *, CASE WHEN verdict = 'CAUSAL_INELIGIBLE' THEN 'CAUSAL_REJECTED' WHEN evidence_tier = 'T2_ARITHMETIC' THEN 'ARITHMETIC_ONLY' WHEN evidence_tier = 'T1_DESCRIPTIVE' THEN 'DESCRIPTIVE_ONLY' ELSE 'CAUSAL_SUPPORTED' END AS status FROM te)"""


def statuses(c):
    return C.result_status(methods(c), F.col("hypothesis_id").endswith("9"))


query("k12_tier_and_status", f"WITH {_STATUS} SELECT * FROM st")(statuses)
query(
    "k13_layer_results",
    f"WITH {_STATUS} SELECT evidence_tier, status, count(*) AS hypotheses, bool_or(claim_allowed) AS any_claim FROM st GROUP BY ALL",
)(lambda c: statuses(c).groupBy("evidence_tier", "status").agg(F.count("*").alias("hypotheses"), F.bool_or("claim_allowed").alias("any_claim")))
query("k14_graph_rows", f"""WITH {_STATUS} SELECT hypothesis_id AS src, 'method:' || method AS dst, 'TESTED_BY' AS relationship_type FROM st UNION ALL SELECT hypothesis_id, 'status:' || status, CASE WHEN status = 'CAUSAL_REJECTED' THEN 'REJECTED_BY' WHEN status = 'CAUSAL_SUPPORTED' THEN 'SUPPORTED_BY' ELSE 'DOWNGRADED_TO' END FROM st
    UNION ALL SELECT hypothesis_id, 'check:' || check_name, 'FAILED' FROM chks WHERE status = 'HARD_FAIL'""")(
    lambda c: (lambda s: s.select(F.col("hypothesis_id").alias("src"), F.concat(F.lit("method:"), "method").alias("dst"), F.lit("TESTED_BY").alias("relationship_type")).union(s.select("hypothesis_id", F.concat(F.lit("status:"), "status"), F.when(F.col("status") == "CAUSAL_REJECTED", "REJECTED_BY").when(F.col("status") == "CAUSAL_SUPPORTED", "SUPPORTED_BY").otherwise("DOWNGRADED_TO"))))(statuses(c))
    .union(checks(c).where("status = 'HARD_FAIL'").select("hypothesis_id", F.concat(F.lit("check:"), "check_name"), F.lit("FAILED")))
)

# Evidence of a hypothesis: the segments of one type; those that move with the total support it.
_CLS = f"""{_seg_sql()}, raw AS (SELECT segment_type AS hypothesis_id, segment_value, sample_size, history_months, confidence, CASE WHEN segment_type = 'seller_state' THEN 'CONCURRENT_KPI' ELSE 'SEGMENT_CONTRIBUTION' END AS evidence_type, CASE WHEN share_of_total > 0 THEN 'SUPPORTS' WHEN share_of_total < 0 THEN 'CONTRADICTS' ELSE 'CONTEXT' END AS classification FROM seg),
    cls AS (SELECT * REPLACE (CASE WHEN evidence_type = 'CONCURRENT_KPI' THEN 'CONTEXT' WHEN confidence IN ('LOW', 'UNKNOWN') OR sample_size < 15 THEN 'INSUFFICIENT' ELSE classification END AS classification) FROM raw),
    sev AS (SELECT *, CASE WHEN contradicts >= 3 THEN 'STRONG' WHEN contradicts >= 2 THEN 'MODERATE' WHEN contradicts = 1 THEN 'WEAK' ELSE 'NONE' END AS severity FROM (SELECT hypothesis_id, count(*) FILTER (classification = 'CONTRADICTS') AS contradicts FROM cls GROUP BY 1)),
    rk AS (SELECT hypothesis_id, CASE WHEN bool_or(classification = 'SUPPORTS') THEN 2 ELSE 0 END AS r FROM cls GROUP BY 1), mth AS (SELECT hypothesis_id, CASE WHEN r = 0 THEN 'INSUFFICIENT_DATA' WHEN severity = 'STRONG' THEN 'T1_DESCRIPTIVE' ELSE 'T2_ARITHMETIC' END AS method, r > 0 AND severity = 'STRONG' AS downgraded FROM rk JOIN sev USING (hypothesis_id))"""


def classified(c):
    s = segments(c)
    share = F.col("share_of_total")
    return C.classification_floor(
        s.select(
            F.col("segment_type").alias("hypothesis_id"), "segment_value", "sample_size", "confidence", F.when(F.col("segment_type") == "seller_state", "CONCURRENT_KPI").otherwise("SEGMENT_CONTRIBUTION").alias("evidence_type"), F.lit("T2_ARITHMETIC").alias("evidence_tier"), F.lit("SAFE").alias("safety"),
            F.when(share > 0, "SUPPORTS").when(share < 0, "CONTRADICTS").otherwise("CONTEXT").alias("classification"), F.lit(1.0).alias("reliability"), F.lit(None).cast("double").alias("freshness"), F.least(F.lit(1.0), F.col("history_months") / 6).alias("history"), F.lit(False).alias("retrieval_failed"),
        )
    )


def severity(c):
    return C.contradictions(classified(c), c.spark.createDataFrame([], "hypothesis_id string, z double, n long"))


query(
    "k15_classified_evidence",
    f"WITH {_CLS} SELECT hypothesis_id, segment_value, classification FROM cls",
)(lambda c: classified(c).select("hypothesis_id", "segment_value", "classification"))
query("k16_contradiction_severity", f"WITH {_CLS} SELECT * FROM sev")(severity)
query("k17_method_rank", f"WITH {_CLS} SELECT * FROM mth")(lambda c: C.rank_methods(classified(c), severity(c)))
query("k18_confidence", f"""WITH {_CLS}, s AS (SELECT hypothesis_id, count(*) FILTER (classification = 'SUPPORTS') / count(*)::DOUBLE AS completeness, count(*) FILTER (classification = 'SUPPORTS') AS supports, coalesce(avg(least(1.0, history_months / 6::DOUBLE)) FILTER (classification = 'SUPPORTS'), 0) AS hist FROM cls GROUP BY 1),
    x AS (SELECT *, CASE severity WHEN 'STRONG' THEN 1.0 WHEN 'MODERATE' THEN 0.5 WHEN 'WEAK' THEN 0.15 ELSE 0 END AS pen FROM s JOIN sev USING (hypothesis_id) JOIN mth USING (hypothesis_id)),
    z AS (SELECT *, greatest(0, least(1, 0.25 * completeness + CASE WHEN supports > 0 THEN 0.2 + 0.15 * 0.6 ELSE 0 END + 0.15 * hist - 0.3 * pen))::DOUBLE AS score FROM x)
    SELECT hypothesis_id, round(completeness, 6) AS completeness, supports, round(score, 6) AS score, CASE WHEN supports = 0 OR method = 'INSUFFICIENT_DATA' THEN 'ABSTAIN' WHEN score >= 0.75 THEN CASE WHEN severity = 'STRONG' THEN 'MEDIUM' ELSE 'HIGH' END WHEN score >= 0.5 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'ABSTAIN' END AS level FROM z""")(lambda c: C.confidence(classified(c), severity(c), C.rank_methods(classified(c), severity(c))))
