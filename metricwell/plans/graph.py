"""Queries of group J over the evidence package: duplicates and digest, the property graph, its access filter, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import graph as G
from ..operators import text as X
from .analytics import _NOW
from .bundle import _BUNDLE, bundle
from .reviews import _META, metadata
from .sql import Registry
from .text import _RED

query = Registry()
_HASH = "substr(sha256('{kind}|' || {subject}), 1, 16)"
_REV = f"""{_META}, {_BUNDLE}, rev AS (SELECT 'ev_rev_' || {_HASH.format(kind='CUSTOMER_REVIEW', subject='review_id')} AS evidence_id, 'CUSTOMER_REVIEW' AS evidence_type, 'T1_DESCRIPTIVE' AS evidence_tier, 'review:' || review_id AS subject,
      r.review_score::DOUBLE AS value, CASE WHEN category IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence, 'a review of score ' || r.review_score AS claim, NULL::DOUBLE AS historical_sufficiency,
      CASE WHEN seller_id IS NOT NULL THEN 'INTERNAL' ELSE 'PUBLIC_ANALYTICAL' END AS classification, m.order_id AS customer_id, seller_id, month, category, review_row_id, pii
    FROM meta m JOIN (SELECT review_row_id, review_id, review_score FROM fact_reviews) r USING (review_row_id)),
    pkg AS (SELECT *, NULL::BIGINT AS customer_id, NULL::BIGINT AS seller_id, CASE WHEN subject LIKE 'seller_state:%' THEN substr(subject, 14) END AS seller FROM ev UNION ALL SELECT * EXCLUDE (month, category, review_row_id, pii), NULL FROM rev),
    mvt AS (SELECT evidence_id, subject, value FROM ev WHERE evidence_type = 'KPI_MOVEMENT')"""
_MOVED = "'ev_mov_' || " + _HASH.format(kind="KPI_MOVEMENT", subject="'{kpi}'")
_SEGMENT = "'ev_seg_' || " + _HASH.format(kind="SEGMENT_CONTRIBUTION", subject="'product_category:' || category")
_INVESTIGATION = f"investigation_{_NOW}"


def reviews(c):
    """Reviews as evidence, by the id of the review, which several rows may share."""
    rows = metadata(c).join(c.fact_reviews.select("review_row_id", "review_id"), "review_row_id")
    sure = F.when(F.col("category").isNull(), "LOW").otherwise("MEDIUM")
    named = F.col("seller_id").isNotNull()
    own = E.rows(
        rows.withColumn("_subject", F.concat(F.lit("review:"), F.col("review_id").cast("string"))),
        "CUSTOMER_REVIEW", "rev", F.col("_subject"), F.col("review_score"), sure, F.concat(F.lit("a review of score "), F.col("review_score").cast("string")), None, named,
        kept=("order_id", "seller_id", "month", "category", "review_row_id", "pii", "review_id"),
    )
    return own.withColumn("evidence_id", E.evidence_id("rev", F.lit("CUSTOMER_REVIEW"), F.col("review_id").cast("string")))


def package(c):
    """All evidence of the month: what the engine computed and the reviews; written once for a query."""

    def build():
        seller = F.when(F.col("subject").startswith("seller_state:"), F.substring("subject", 14, 1000))
        computed = bundle(c).withColumn("customer_id", F.lit(None).cast("long")).withColumn("seller_id", F.lit(None).cast("long")).withColumn("seller", seller)
        own = reviews(c).withColumnRenamed("order_id", "customer_id").withColumn("seller", F.lit(None).cast("string"))
        return computed.unionByName(own.select(*computed.columns))

    return c.stored("evidence package", build)


_COLUMNS = ["evidence_id", "evidence_type", "evidence_tier", "subject", "claim", "confidence", "classification", "customer_id", "seller_id", "seller"]
query("j7_duplicate_evidence", f"WITH {_REV} SELECT evidence_id, count(*) AS n FROM pkg GROUP BY 1 HAVING count(*) > 1")(
    lambda c: package(c).groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1")
)
_PRINT = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _COLUMNS)
query("j7_package_digest", f"""WITH RECURSIVE {_REV}, d AS (SELECT sha256({_PRINT}) AS digest FROM pkg), z AS (SELECT greatest(0, ceil(round(log(count(*) / {G.LEAF}.0) / log(16.0), 9)))::BIGINT AS digits, count(*) AS items FROM d),
    up AS (SELECT digits, substr(digest, 1, digits) AS prefix, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM d, z GROUP BY 1, 2
      UNION ALL SELECT digits - 1, substr(prefix, 1, digits - 1), sha256(string_agg(digest, '' ORDER BY prefix)) FROM up WHERE digits > 0 GROUP BY 1, 2)
    SELECT items, digest FROM up, z WHERE up.digits = 0""")(lambda c: G.content_digest(package(c), _COLUMNS))  # fmt: skip


def graph(c):
    """Nodes and edges of the month's investigation, made of the evidence package; both written once for a query."""

    def nodes():
        attrs = G.attributes(**{n: F.col(n) for n in ("evidence_type", "evidence_tier", "claim", "confidence", "customer_id", "seller_id", "seller")})
        rows = package(c)
        evidence = G.nodes_of(rows, attrs)
        open_level = F.lit(None).cast("string")
        moved = rows.where("evidence_type = 'KPI_MOVEMENT'")
        kpis = moved.select(F.concat(F.lit("kpi_"), "subject").alias("node"), F.lit("KPI").alias("node_type"), open_level, G.attributes(kpi_id=F.col("subject")))
        sure = rows.where(F.col("evidence_type").isin(*G.NODE_TYPES)).select(F.concat(F.lit("confidence_of_"), "evidence_id"), F.lit("CONFIDENCE"), open_level, G.attributes(confidence=F.col("confidence")))
        asked = c.spark.range(1).select(F.lit(_INVESTIGATION), F.lit("INVESTIGATION"), open_level, G.attributes(question=F.lit("why did revenue move")))
        return evidence.union(kpis).union(sure).union(asked)

    def edges():
        rows = package(c)
        moved, segments = rows.where("evidence_type = 'KPI_MOVEMENT'"), rows.where("evidence_type = 'SEGMENT_CONTRIBUTION'")
        drivers = rows.where("evidence_type = 'DRIVER_CONTRIBUTION'")
        moves = lambda kpi: E.evidence_id("mov", F.lit("KPI_MOVEMENT"), F.lit(kpi))
        change = moved.where("subject = 'revenue'").select("evidence_id", F.signum("value").alias("sign"))
        signals = rows.where("evidence_type = 'ANOMALY_SIGNAL'")
        said = reviews(c)
        about = said.where("category IS NOT NULL").select("evidence_id", E.evidence_id("seg", F.lit("SEGMENT_CONTRIBUTION"), F.concat(F.lit("product_category:"), "category")).alias("segment")).distinct()
        known = segments.where("subject LIKE 'product_category:%'").select(F.col("evidence_id").alias("segment"))
        parts = [
            moved.select(F.lit(_INVESTIGATION).alias("src"), F.col("evidence_id").alias("dst"), F.lit("HAS_MOVEMENT").alias("relationship_type")),
            moved.select(F.concat(F.lit("kpi_"), "subject"), "evidence_id", F.lit("HAS_MOVEMENT")),
            rows.where(F.col("evidence_type").isin(*G.NODE_TYPES)).select("evidence_id", F.concat(F.lit("confidence_of_"), "evidence_id"), F.lit("HAS_CONFIDENCE")),
            drivers.unionByName(segments).select(moves("revenue"), "evidence_id", F.lit("EXPLAINED_BY")),
            said.where(F.col("month") == _NOW).select(moves("avg_delivery_days"), "evidence_id", F.lit("SUPPORTED_BY")).distinct(),
            about.join(known, "segment", "left_semi").select("evidence_id", "segment", F.lit("CONTEXTUALIZED_BY")),
            segments.crossJoin(F.broadcast(change.withColumnRenamed("evidence_id", "movement"))).where(F.signum("value") == -F.col("sign")).select("evidence_id", "movement", F.lit("CONTRADICTS")),
            signals.select("evidence_id", E.evidence_id("sta", F.lit("STATISTICAL_RESULT"), F.col("subject")), F.lit("DERIVED_FROM")),
        ]
        return reduce(lambda a, b: a.union(b), parts)

    return c.stored("graph nodes", nodes), c.stored("graph edges", edges)


_SHOWN = ("evidence_type", "evidence_tier", "claim", "confidence", "customer_id", "seller_id", "seller")
_TYPE = "CASE evidence_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.NODE_TYPES.items()) + " ELSE 'EVIDENCE' END"
_RATED = ", ".join(f"'{k}'" for k in G.NODE_TYPES)


def _attrs(gone: tuple[str, ...] = ()) -> str:
    parts = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}=' || {n}::VARCHAR END" for n in sorted(_SHOWN) if n not in gone)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ';')"


def _nodes(gone: tuple[str, ...] = ()) -> str:
    order = f"{_TYPE}, classification, array_to_string(list_filter([{', '.join(f'{n}::VARCHAR' for n in sorted(_SHOWN))}], lambda x: x IS NOT NULL), chr(1))"
    return f"""nd AS (SELECT evidence_id AS node, {_TYPE} AS node_type, classification, {_attrs(gone)} AS attrs FROM pkg QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY {order}) = 1
      UNION ALL SELECT 'kpi_' || subject, 'KPI', NULL, 'kpi_id=' || subject FROM mvt UNION ALL SELECT 'confidence_of_' || evidence_id, 'CONFIDENCE', NULL, 'confidence=' || confidence FROM ev WHERE evidence_type IN ({_RATED})
      UNION ALL SELECT '{_INVESTIGATION}', 'INVESTIGATION', NULL, 'question=why did revenue move')"""


_EDGES = f"""ed AS (SELECT '{_INVESTIGATION}' AS src, evidence_id AS dst, 'HAS_MOVEMENT' AS relationship_type FROM mvt UNION ALL SELECT 'kpi_' || subject, evidence_id, 'HAS_MOVEMENT' FROM mvt
      UNION ALL SELECT evidence_id, 'confidence_of_' || evidence_id, 'HAS_CONFIDENCE' FROM ev WHERE evidence_type IN ({_RATED})
      UNION ALL SELECT {_MOVED.format(kpi='revenue')}, evidence_id, 'EXPLAINED_BY' FROM ev WHERE evidence_type IN ('DRIVER_CONTRIBUTION', 'SEGMENT_CONTRIBUTION')
      UNION ALL SELECT DISTINCT {_MOVED.format(kpi='avg_delivery_days')}, evidence_id, 'SUPPORTED_BY' FROM rev WHERE month = '{_NOW}'
      UNION ALL SELECT DISTINCT evidence_id, {_SEGMENT}, 'CONTEXTUALIZED_BY' FROM rev WHERE category IS NOT NULL AND {_SEGMENT} IN (SELECT evidence_id FROM ev WHERE evidence_type = 'SEGMENT_CONTRIBUTION')
      UNION ALL SELECT e.evidence_id, mvt.evidence_id, 'CONTRADICTS' FROM ev e, mvt WHERE e.evidence_type = 'SEGMENT_CONTRIBUTION' AND mvt.subject = 'revenue' AND sign(e.value) = -sign(mvt.value)
      UNION ALL SELECT evidence_id, 'ev_sta_' || {_HASH.format(kind='STATISTICAL_RESULT', subject='subject')}, 'DERIVED_FROM' FROM ev WHERE evidence_type = 'ANOMALY_SIGNAL')"""
_ALLOWED = {"PUBLIC_ANALYTICAL": "coalesce(classification, 'PUBLIC_ANALYTICAL') = 'PUBLIC_ANALYTICAL'", "INTERNAL": "coalesce(classification, 'PUBLIC_ANALYTICAL') IN ('PUBLIC_ANALYTICAL', 'INTERNAL')"}


def _left(clearance: str) -> str:
    shown = f"(SELECT node FROM nd WHERE {_ALLOWED[clearance]})"
    return f"(SELECT * FROM ed WHERE src IN {shown} AND dst IN {shown})"


def _listed(nodes):
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return nodes.select("node", "node_type", F.array_join(pairs, ";").alias("attrs"))


query("j8_graph_nodes", f"WITH {_REV}, {_nodes()} SELECT node, node_type, attrs FROM nd")(lambda c: _listed(graph(c)[0]))
query("j8_graph_edges", f"WITH {_REV}, {_EDGES} SELECT * FROM ed")(lambda c: graph(c)[1])
query("j12_access_filtered_nodes", f"WITH {_REV}, {_nodes(G.NEVER + G.INTERNAL_ONLY)} SELECT node, node_type, attrs FROM nd WHERE {_ALLOWED['PUBLIC_ANALYTICAL']}")(
    lambda c: _listed(G.visible_nodes(graph(c)[0], "PUBLIC_ANALYTICAL"))
)
query("j12_access_filtered_edges", f"WITH {_REV}, {_nodes()}, {_EDGES} SELECT * FROM {_left('PUBLIC_ANALYTICAL')}")(lambda c: G.visible_edges(*graph(c), "PUBLIC_ANALYTICAL"))
query("j13_neighbours", f"WITH {_REV}, {_nodes()}, {_EDGES}, v AS {_left('INTERNAL')} SELECT dst AS neighbour, relationship_type, 'out' AS direction FROM v WHERE src = {_MOVED.format(kpi='revenue')} UNION ALL SELECT src, relationship_type, 'in' FROM v WHERE dst = {_MOVED.format(kpi='revenue')}")(
    lambda c: G.neighbours(G.visible_edges(*graph(c), "INTERNAL"), E.evidence_id("mov", F.lit("KPI_MOVEMENT"), F.lit("revenue")))
)
query("j17_graph_export", f"WITH {_REV}, {_nodes()}, {_EDGES} " + " UNION ALL ".join(f"SELECT '{v}' AS clearance, 'node' AS kind, node_type AS type, count(*) AS n FROM nd WHERE {t} GROUP BY 3 UNION ALL SELECT '{v}', 'edge', relationship_type, count(*) FROM {_left(v)} GROUP BY 3" for v, t in _ALLOWED.items()))(
    lambda c: reduce(lambda a, b: a.unionByName(b), (G.counted(*graph(c), v) for v in _ALLOWED))
)
query("j17_contradictions", f"WITH {_REV}, {_nodes()}, {_EDGES} SELECT src, dst FROM {_left('INTERNAL')} WHERE relationship_type = 'CONTRADICTS'")(
    lambda c: G.visible_edges(*graph(c), "INTERNAL").where("relationship_type = 'CONTRADICTS'").select("src", "dst")
)
_DATA = _RED.replace("text", "d.text")
query("j15_evidence_lookup", f"""WITH {_REV} SELECT rev.evidence_id, review_row_id, CASE WHEN pii <> '' THEN 'REDACTED_AT_RETRIEVAL' ELSE 'NOT_REDACTED' END AS redaction_status, md5(CASE WHEN pii <> '' THEN {_DATA} ELSE coalesce(d.text, '') END) AS content
    FROM rev JOIN documents d ON d.doc_id = review_row_id WHERE classification = 'PUBLIC_ANALYTICAL' UNION ALL SELECT evidence_id, NULL, 'NOT_REDACTED', md5(claim) FROM ev WHERE classification = 'PUBLIC_ANALYTICAL'""")(lambda c: lookup(c))  # fmt: skip


def lookup(c, clearance: str = "PUBLIC_ANALYTICAL"):
    """What a clearance may see of all evidence, texts with personal data redacted; what it may not see is simply absent."""
    said = E.visible(reviews(c), clearance).join(c.raw("documents").select(F.col("doc_id").alias("review_row_id"), "text"), "review_row_id")
    content, status = E.redacted(F.coalesce("text", F.lit("")), F.col("pii") != "")
    rows = said.select("evidence_id", "review_row_id", status.alias("redaction_status"), content.alias("content"))
    own = E.visible(package(c).where("evidence_type <> 'CUSTOMER_REVIEW'"), clearance)
    rows = rows.unionByName(own.select("evidence_id", F.lit(None).cast("long").alias("review_row_id"), F.lit("NOT_REDACTED").alias("redaction_status"), F.col("claim").alias("content")))
    return rows.withColumn("content", F.md5(F.col("content").cast("binary")))
