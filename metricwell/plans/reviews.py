"""Queries of groups C and I over reviews and their metadata: structured filters, the ladder of search, evidence, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from .canonical import _ATTR, attribution, of_reviews
from .retrieval import _EXP, _LANG, _PER, _TAIL, _VEC, _metrics, asked, synonyms
from .sql import Registry
from .text import _BM25, _CATEGORY, _QT, PII_SQL, SAFETY_SQL, bm25, index, relevant

query = Registry()

_META = f"""{_ATTR[5:]}, meta AS (SELECT a.review_row_id, a.order_id, o.month, category, nullif(seller_id, -1) AS seller_id, seller_state, customer_state, tag AS language, order_status, attribution_method, review_score,
    {SAFETY_SQL.replace('text', 'd.text')} AS security_status, {PII_SQL} AS pii
    FROM att a JOIN documents d ON doc_id = a.review_row_id JOIN {_LANG} l USING (doc_id) JOIN (SELECT review_row_id, review_score FROM fact_reviews) r USING (review_row_id)
    LEFT JOIN (SELECT order_id, month, order_status, customer_state FROM fact_orders) o USING (order_id) LEFT JOIN (SELECT seller_id AS s, seller_state FROM dim_seller) ON s = seller_id)"""


def metadata(c):
    """A row for each review: what filters and evidence need of it and of its order; written once for a query."""

    def build():
        t = F.col("text")
        # what is read from a text is read before the joins, so that no text is shuffled
        texts = c.raw("documents").select(
            F.col("doc_id").alias("review_row_id"), X.language(t).alias("language"), X.safety(t).alias("security_status"),
            F.array_join(X.pii_types(t), ",").alias("pii"), (F.trim(F.coalesce(t, F.lit(""))) != "").alias("has_text"),
        )
        people = of_reviews(c, c.dim_customer.select("customer_id", "customer_state"), "customer_id")  # an order's customer_id is its own id
        orders = of_reviews(c, c.orders).join(people, "customer_id", "left").select("order_id", "month", "order_status", "customer_state")
        out = attribution(c).withColumn("seller_id", F.nullif("seller_id", F.lit(-1))).join(texts, "review_row_id")
        out = out.join(c.fact_reviews.select("review_row_id", "review_score"), "review_row_id").join(orders, "order_id", "left")
        out = out.join(c.dim_seller.select("seller_id", "seller_state"), "seller_id", "left")
        return out.select(
            "review_row_id", "order_id", "month", "category", "seller_id", "seller_state", "customer_state", "language", "order_status", "attribution_method", "review_score",
            "security_status", "pii", "has_text",
        )

    return c.stored("review metadata", build)


# C10
_OPEN = {"language": "en", "score_min": 2, "score_max": 4, "months": ("1996-01", "2000-12")}
_INNER = {"attribution_method": "single_item_order", "order_status": "shipped", "score_min": 2}


def _where(filters: dict, clearance: str = "RESTRICTED") -> str:
    tests = ["security_status <> 'BLOCKED'"] + (["seller_id IS NULL"] if clearance == "PUBLIC_ANALYTICAL" else [])
    for k, v in filters.items():
        tests.append(
            {
                "score_min": f"review_score >= {v}",
                "score_max": f"review_score <= {v}",
                "months": f"coalesce(month BETWEEN '{v[0]}' AND '{v[1]}', true)" if k == "months" else "",
            }.get(k, f"coalesce({k} = '{v}', false)")
        )
    return " AND ".join(tests)


for _name, _filters, _clearance in (("c10_public_filters", _OPEN, "PUBLIC_ANALYTICAL"), ("c10_internal_filters", _INNER, "INTERNAL")):
    query(_name, f"WITH {_META} SELECT review_row_id, month, seller_id FROM meta WHERE {_where(_filters, _clearance)}")(
        lambda c, filters=_filters, clearance=_clearance: metadata(c).where(X.allowed(filters, clearance)).select(
            "review_row_id",
            "month",
            "seller_id",
        )
    )

# I14: every rung is a maximum over the scores of the documents that its filters let through
_FILTERS = {"category": "economy", "customer_state": "NATION_1", "score_min": 4}
_FLOORS = {"bm25": 0.5, "dense": 0.82}
_STEPS = [("bm25", "sc", _FILTERS), ("expansion", "xs", _FILTERS), *((n, "xs", f) for n, f in X.relaxed(_FILTERS)), ("dense", "cs", _FILTERS)]


def _best(i: int, source: str, filters: dict) -> str:
    return f"(SELECT max(score) FROM {source} JOIN meta ON review_row_id = doc_id WHERE {source}.query_id = item_id AND {_where(filters)}) AS s{i}"


_PICK = [(n, f"s{i} >= {_FLOORS.get(n, _FLOORS['bm25'])}", f"s{i}") for i, (n, *_) in enumerate(_STEPS)]
query("i14_ladder", f"""WITH {_META}, {_BM25}, {_EXP}, {_TAIL}, {_VEC}, s AS (SELECT item_id AS query_id, {', '.join(_best(i, t, f) for i, (_, t, f) in enumerate(_STEPS))} FROM benchmark)
    SELECT query_id, rung, CASE WHEN rung = 'insufficient' THEN coalesce(greatest(s0, s1), 0) ELSE best END AS best, CASE WHEN rung = 'insufficient' THEN few END AS candidates, CASE WHEN rung = 'insufficient' THEN round(few / n_all::DOUBLE, 6) END AS coverage
    FROM (SELECT *, CASE {' '.join(f"WHEN {t} THEN '{n}'" for n, t, _ in _PICK)} ELSE 'insufficient' END AS rung, CASE {' '.join(f"WHEN {t} THEN {v}" for _, t, v in _PICK)} END AS best FROM s), (SELECT count(*) FILTER ({_where(_FILTERS)}) AS few, count(*) AS n_all FROM meta)""")(
    lambda c: ladder(c)
)


def ladder(c):
    """Every rung for every query: one pass over the scores of each search gives the best behind each of its filters."""
    meta = metadata(c)
    few = c.stored("few", lambda: meta.where(X.allowed(_FILTERS)).select(F.col("review_row_id").alias("doc_id")))
    queries = asked(c)

    def best(name, scores, filters):
        flags = meta.select(F.col("review_row_id").alias("doc_id"), *(X.allowed(f).alias(f"f{i}") for i, f in enumerate(filters)))
        each = [F.max(F.when(F.col(f"f{i}"), F.col("score"))).alias(f"s{i}") for i in range(len(filters))]
        rows = c.stored(name, lambda: scores().join(flags, "doc_id").groupBy("query_id").agg(*each))  # a row for each query
        return [rows.select("query_id", F.col(f"s{i}").alias("score")) for i in range(len(filters))]

    own = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    plain = best("best scores", lambda: index(c).scores(own), [f for _, t, f in _STEPS if t == "sc"])
    more = best("best expanded scores", lambda: index(c).scores(X.expand(queries, synonyms(c)).select("query_id", "term")), [f for _, t, f in _STEPS if t == "xs"])
    rungs = [(name, ranking, _FLOORS["bm25"]) for (name, *_), ranking in zip(_STEPS, plain + more, strict=False)]
    texts = X.tokenized(c.raw("documents").join(few, "doc_id", "left_semi"))  # only the texts that the filters let through have to be vectors
    near = X.cosine_top_k(X.hash_vectors(texts, "doc_id").withColumnRenamed("doc_id", "vec_id"), X.hash_vectors(X.tokenized(queries, "query_id"), "query_id"), 1)
    return X.ladder(queries, [*rungs, ("dense", near, _FLOORS["dense"])], few, meta)


# I21, I22: by category of the query, and by its language
_OVERALL = "round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(reciprocal_rank), 5) AS mrr, round(avg(1 - precision), 5) AS irrelevant_rate, count(*) AS queries"
query("i21_metrics_by_category", f"""WITH {_BM25}, {_PER}, m AS ({_metrics('bm')}), q AS (SELECT item_id AS query_id, {_CATEGORY} AS category FROM benchmark q)
    SELECT coalesce(category, 'all') AS category, {_OVERALL} FROM m JOIN q USING (query_id) GROUP BY ROLLUP (category)""")(lambda c: by_category(c))


def measured(c):
    return X.retrieval_metrics(bm25(c), relevant(c), "doc_id")


def _means():
    return [
        F.round(F.avg("precision"), 5).alias("precision"),
        F.round(F.avg("recall"), 5).alias("recall"),
        F.round(F.avg("reciprocal_rank"), 5).alias("mrr"),
        F.round(F.avg(1 - F.col("precision")), 5).alias("irrelevant_rate"),
        F.count("*").alias("queries"),
    ]


def by_category(c):
    n = F.size(X.tokens(F.col("text")))
    kinds = asked(c).select("query_id", F.when(n <= 10, "short").when(n <= 25, "medium").otherwise("long").alias("category"))
    return measured(c).join(kinds, "query_id").rollup("category").agg(*_means()).withColumn("category", F.coalesce("category", F.lit("all")))


query(
    "i22_recall_by_language",
    f"WITH {_BM25}, {_PER}, m AS ({_metrics('bm')}), q AS (SELECT item_id AS query_id, tag "
    f"FROM (SELECT item_id, {_LANG[_LANG.index('CASE'):_LANG.index(' AS tag')]} AS tag {_LANG[_LANG.index('FROM (SELECT *'):-1].replace('doc_id', 'item_id').replace('documents', 'benchmark')})) "
    "SELECT tag AS language, count(*) AS queries, round(avg(recall), 6) AS recall FROM m JOIN q USING (query_id) GROUP BY 1",
)(
    lambda c: measured(c).join(
        asked(c).select("query_id", X.language(F.col("text")).alias("language")),
        "query_id",
    ).groupBy("language").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))
)

# I24
query("i24_review_evidence", f"""WITH {_META} SELECT review_row_id, month, category, customer_state, review_score, attribution_method, CASE WHEN seller_id IS NOT NULL THEN 'INTERNAL' ELSE 'PUBLIC_ANALYTICAL' END AS classification, language, security_status AS safety, pii,
    CASE WHEN category IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS reliability, round(((category IS NOT NULL)::INTEGER + (language <> 'UNKNOWN')::INTEGER + (trim(coalesce(text, '')) <> '')::INTEGER) / 3.0::DOUBLE, 6) AS completeness
    FROM meta JOIN (SELECT doc_id AS review_row_id, text FROM documents) USING (review_row_id)""")(lambda c: evidence(c))  # fmt: skip


def evidence(c):
    known = F.col("category").isNotNull().cast("int") + (F.col("language") != "UNKNOWN").cast("int") + F.col("has_text").cast("int")
    return metadata(c).select(
        "review_row_id", "month", "category", "customer_state", "review_score", "attribution_method", F.when(F.col("seller_id").isNotNull(), "INTERNAL").otherwise("PUBLIC_ANALYTICAL").alias("classification"), "language",
        F.col("security_status").alias("safety"), "pii", F.when(F.col("category").isNull(), 0.5).otherwise(1.0).alias("reliability"), F.round(known / 3.0, 6).alias("completeness"),
    )
