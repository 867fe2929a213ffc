"""Further queries of group I: normalisation, expansion, embedding, hybrid retrieval, reranking and its evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import text as X
from ..sources.tables import scratch, store
from .sql import Registry
from .text import _ALL_TOK, _BM25, _KINDS, _QT, _RED, _REL, _TOK, PII_SQL, asked, bm25, index, relevant, words

query = Registry()
_DOC = lambda c: c.raw("documents")
query("i1_normalise", r"SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(CASE WHEN trim(coalesce(source, '')) = '' THEN text WHEN trim(coalesce(text, '')) = '' THEN source ELSE source || ' ' || text END), '\s+', ' ', 'g')) AS t FROM documents)")(
    lambda c: _DOC(c).select("doc_id", X.normalise(X.joined_title(F.col("source"), F.col("text"))).alias("t")).select(
        "doc_id",
        F.md5(F.col("t").cast("binary")).alias("digest"),
        F.length("t").cast("long").alias("chars"),
    )
)
_SYN = f"syn AS (SELECT term, CASE WHEN term = a THEN b ELSE a END AS synonym FROM (SELECT DISTINCT unnest({_QT}) AS term FROM benchmark q) JOIN (SELECT substr(term, 1, 4) AS p, min(term) AS a, max(term) AS b FROM (SELECT DISTINCT unnest({_QT}) AS term FROM benchmark q) GROUP BY 1) ON p = substr(term, 1, 4) WHERE a <> b UNION VALUES {', '.join(f"('{t}', '{x}')" for t, more in X.SYNONYMS.items() for x in more)})"
_EXP = f"{_SYN}, own AS (SELECT DISTINCT item_id AS query_id, unnest({_QT}) AS term FROM benchmark q), ex AS (SELECT *, true AS original FROM own UNION ALL SELECT DISTINCT query_id, synonym, false FROM own JOIN syn USING (term) WHERE (query_id, synonym) NOT IN (SELECT (query_id, term) FROM own))"


def synonyms(c):
    """The governed table, and a stand-in where the queries hold none of its words: another term with the same four letters."""
    words = asked(c).select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct().withColumn("p", F.substring("term", 1, 4))
    ends = words.groupBy("p").agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a <> b")
    return words.join(ends, "p").select(
        "term",
        F.when(F.col("term") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("synonym"),
    ).unionByName(X.synonym_table(c.spark)).distinct()


def expanded(c, k=10):
    return c.stored(f"expanded {k}", lambda: index(c).top(X.expand(asked(c), synonyms(c)).select("query_id", "term"), k))


def vectors(c):
    return c.stored("vectors", lambda: X.hash_vectors(words(c), "doc_id"))


def dense(c, k=10, docs=None):
    """By cosine over all documents, or over the doc_ids of docs."""
    among = vectors(c) if docs is None else vectors(c).join(docs.select("doc_id"), "doc_id", "left_semi")
    return X.cosine_top_k(
        among.withColumnRenamed("doc_id", "vec_id"),
        X.hash_vectors(X.tokenized(asked(c), "query_id"), "query_id"),
        k,
    ).withColumnRenamed("vec_id", "doc_id")


def hybrid(c, k=10):
    pool = max(3 * k, k + 20)
    return X.fuse(bm25(c, pool), dense(c, pool), key="doc_id", k=k)


def hybrid_expanded(c, k=10):
    pool = max(3 * k, k + 20)
    return X.fuse(expanded(c, pool), dense(c, pool), key="doc_id", k=k)


def _vec(key: str, source: str, tok: str) -> str:
    return f"SELECT {key}, list_transform(range(64), lambda i: coalesce(map_from_entries(list((bucket, n)))[i], 0)::DOUBLE) AS e FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 4))::INTEGER % 64 AS bucket, count(*) AS n FROM (SELECT {key}, unnest({tok}) AS term FROM {source}) GROUP BY 1, 2) GROUP BY 1"


_VEC = f"dv AS ({_vec('doc_id', 'documents', _TOK)}), qv AS ({_vec('query_id', '(SELECT item_id AS query_id, text FROM benchmark) q', _QT)}), cs AS (SELECT query_id, doc_id, round(list_cosine_similarity(qv.e, dv.e), 6) AS score FROM qv, dv)"


def _top(source: str, k: int, more: str = "") -> str:
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {source}{more}) WHERE rank <= {k}"


query("i3_query_expansion", f"WITH {_EXP} SELECT * FROM ex")(lambda c: X.expand(asked(c), synonyms(c)))
_MODEL = "hash64-1"
query("i8_embedding_job", f"""WITH k AS (SELECT sha256(text || '|{_MODEL}') AS key, any_value(text) AS text, CASE WHEN bool_or(coalesce(lang = 'en', false)) THEN 0 ELSE 1 END AS run FROM documents WHERE text IS NOT NULL GROUP BY 1),
    b AS (SELECT key, ('0x' || substr(md5(term), 1, 4))::INTEGER % 64 AS bucket, count(*) AS n FROM (SELECT key, unnest({_TOK}) AS term FROM k) GROUP BY 1, 2)
    SELECT key, run::INTEGER AS run, coalesce(string_agg(bucket || ':' || n, ',' ORDER BY bucket), '') AS vector FROM k LEFT JOIN b USING (key) GROUP BY 1, 2""")(lambda c: embedding_job(c))


def embedding_job(c):
    """Three runs into one store: the documents of one language, all documents, and all again, which adds nothing."""
    path = scratch(c.spark)
    embedder = lambda new: X.hash_vectors(X.tokenized(new, "key"), "key", empty=True)
    for run, docs in enumerate((_DOC(c).where("lang = 'en'"), _DOC(c), _DOC(c))):
        X.embed_new(docs, path, run, _MODEL, embedder)
    parts = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, F.concat_ws(":", i, x.cast("long")))), lambda x: x.isNotNull())
    return X.embedded(c.spark, path).select("key", "run", F.array_join(parts, ",").alias("vector"))


_B30 = _BM25.replace("rank <= 10", "rank <= 30")
_HYB = f"{_B30}, {_VEC}, dn AS ({_top('cs', 30)}), un AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM dn), fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM un GROUP BY 1, 2), hy AS ({_top('fu', 10)})"
query("i10_hybrid", f"WITH {_HYB} SELECT * FROM hy")(hybrid)
def _mmr(source: str, k: int) -> str:
    """SQL of the greedy rerank of source (query_id, doc_id, score, e), as CTEs that end in mr (query_id, doc_id, rank)."""
    near = "CASE WHEN step = 0 THEN 0 ELSE list_max(list_transform(vecs, lambda v: list_cosine_similarity(v, p.e))) END"
    return f"""mp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS ord FROM ({source})),
    mm AS (SELECT DISTINCT query_id, 0 AS step, []::BIGINT[] AS ids, []::DOUBLE[][] AS vecs FROM mp UNION ALL
      SELECT query_id, step + 1, list_append(ids, b.doc_id), list_append(vecs, b.e) FROM (
        SELECT m.query_id, step, ids, vecs, first({{'doc_id': p.doc_id, 'e': p.e}} ORDER BY round({X.MMR} * score - (1 - {X.MMR}) * {near}, 9) DESC, ord) AS b
        FROM mm m JOIN mp p USING (query_id) WHERE step < {k} AND NOT list_contains(ids, p.doc_id) GROUP BY m.query_id, step, ids, vecs)),
    mr AS (SELECT query_id, unnest(ids) AS doc_id, generate_subscripts(ids, 1)::INTEGER AS rank FROM (SELECT * FROM mm QUALIFY step = max(step) OVER (PARTITION BY query_id)))"""


#: Filters of the structured search, and the relevance from which a text may be shown.
_STRUCTURED, _RELEVANT = "lang = 'en' AND n_chars >= 200", 0.5
_FIRST = f"{_VEC}, fs AS (SELECT cs.*, dv.e FROM cs JOIN documents USING (doc_id) JOIN dv USING (doc_id) WHERE {_STRUCTURED}), f50 AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50)"
_SELECTED = f"WITH RECURSIVE {_FIRST}, {_mmr(f'SELECT query_id, doc_id, score, e FROM f50 WHERE score >= {_RELEVANT}', 10)}"
_KIND = f"CASE WHEN {PII_SQL} <> '' THEN 'REDACTED_AT_RETRIEVAL' ELSE 'NOT_REDACTED' END"
query("i11_structured_first", f"{_SELECTED} SELECT query_id, doc_id, rank, score, {_KIND} AS redaction_status, md5(CASE WHEN {PII_SQL} <> '' THEN {_RED} ELSE coalesce(text, '') END) AS content FROM mr JOIN f50 USING (query_id, doc_id) JOIN documents USING (doc_id)")(
    lambda c: structured_first(c)[0]
)
query("i11_retrieval_counts", f"{_SELECTED} SELECT (SELECT count(*) FROM documents) AS candidates_before_filter, (SELECT count(*) FROM documents WHERE {_STRUCTURED}) AS candidates_after_filter, (SELECT count(*) FROM f50) AS pool, (SELECT count(*) FROM mp) AS relevant, (SELECT count(*) FROM mr) AS returned")(
    lambda c: c.spark.createDataFrame([structured_first(c)[1]])
)


def structured_first(c, k: int = 10):
    """Rows and counts of a governed search: filter, the best 5k by cosine, least relevance, rerank, redacted texts.

    Counts are observed while the rows are made, in the passes that make them.
    """
    before, after, pooled, kept, out = (Observation(n) for n in ("before", "after", "pool", "relevant", "returned"))
    n = F.count(F.lit(1)).alias("n")
    docs = _DOC(c).select("doc_id", "lang", "n_chars").observe(before, n).where(_STRUCTURED).observe(after, n)
    among = store(docs.select("doc_id"))
    pool = dense(c, 5 * k, among).drop("rank").observe(pooled, n).where(F.col("score") >= _RELEVANT).observe(kept, n)
    pool = store(pool)
    ranked = X.mmr(pool.join(vectors(c), "doc_id"), k).join(pool, ["query_id", "doc_id"]).join(_DOC(c).select("doc_id", "text"), "doc_id")
    content, status = E.redacted(F.coalesce("text", F.lit("")), F.size(X.pii_types(F.col("text"))) > 0)
    rows = ranked.observe(out, n).select("query_id", "doc_id", "rank", "score", status.alias("redaction_status"), F.md5(content.cast("binary")).alias("content"))
    rows = store(rows)
    names = ("candidates_before_filter", "candidates_after_filter", "pool", "relevant", "returned")
    return rows, Row(**{name: o.get["n"] for name, o in zip(names, (before, after, pooled, kept, out), strict=True)})


@query("i12_mmr", f"WITH RECURSIVE {_VEC}, t30 AS (SELECT cs.*, dv.e FROM cs JOIN dv USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30), {_mmr('SELECT * FROM t30', 10)} SELECT * FROM mr")
def _reranked(c):
    pool = dense(c, 30).drop("rank")
    return X.mmr(pool.join(vectors(c), "doc_id"), 10)


query(
    "i13_diversity",
    f"WITH {_B30}, j AS (SELECT bm.*, lang FROM bm "
    "JOIN documents USING (doc_id)), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang "
    "ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, lang) AS best "
    "FROM j), n AS (SELECT query_id, doc_id, lang, row_number() OVER (PARTITION BY query_id ORDER BY turn, best)::INTEGER AS rank "
    "FROM t) SELECT * FROM n WHERE rank <= 10",
)(lambda c: X.diversify(bm25(c, 30).join(_DOC(c).select("doc_id", "lang"), "doc_id"), "lang", 10))
_BX = _BM25.replace(
    "qt AS (SELECT DISTINCT item_id AS query_id, unnest(" + _QT + ") AS term FROM benchmark q)",
    "qt AS (SELECT query_id, term FROM ex)",
).replace("sc AS", "xs AS").replace("FROM sc", "FROM xs").replace("bm AS", "bx AS")
_TAIL = _BX[_BX.index("xs AS"):].replace("FROM qt JOIN", "FROM ex JOIN")
_CNT = {k: f"len(list_filter(w, lambda x: x IN {v}))" for k, v in X.WORDS.items()}
_LANG = f"(SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 10 OR greatest({', '.join(_CNT)}) = 0 THEN 'UNKNOWN' " + " ".join(
    f"WHEN {k} = greatest({', '.join(_CNT)}) THEN '{k}'" for k in sorted(_CNT)
) + " END AS tag FROM (SELECT *, " + ", ".join(
    f"{v} AS {k}" for k, v in _CNT.items()
) + f" FROM (SELECT doc_id, text, {_ALL_TOK} AS w FROM documents)))"
query("i18_language_tag", f"SELECT * FROM {_LANG}")(lambda c: _DOC(c).select("doc_id", X.language(F.col("text")).alias("tag")))
#: String columns of the structured tables; the operator finds them in the schemas.
_STR = {
    "region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "part": ("p_name", "p_brand", "p_type"), "orders": ("o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_returnflag", "l_linestatus"), "events": ("event_type", "props"), "pages": ("url", "html"), "labels": (),
}
query("i20_pii_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{x}' AS column, '{k}' AS kind, count(*) FILTER ({p.replace('text', x)}) AS n FROM {t}" for t, xs in _STR.items() for x in xs for k, p in sorted(_KINDS.items())))(
    lambda c: X.pii_columns({t: c.raw(t) for t in _STR})
)
_PER = f"{_REL}, wn AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1)"


def _metrics(source: str) -> str:
    return f"SELECT query_id, round(hits / returned::DOUBLE, 6) AS precision, round(hits / relevant::DOUBLE, 6) AS recall, round(coalesce(1 / f::DOUBLE, 0), 6) AS reciprocal_rank FROM (SELECT query_id, count(*) AS returned, count(rel.doc_id) AS hits, min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END) AS f FROM {source} LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1) JOIN wn USING (query_id)"


query("i22_recall_by_length", f"WITH {_BM25}, {_PER}, m AS ({_metrics('bm')}), q AS (SELECT item_id AS query_id, len({_QT}) AS n FROM benchmark q) SELECT CASE WHEN n <= 3 THEN '1-3' WHEN n <= 10 THEN '4-10' WHEN n <= 25 THEN '11-25' ELSE '26+' END AS bucket, count(*) AS queries, round(avg(recall), 6) AS recall FROM m JOIN q USING (query_id) GROUP BY 1")(
    lambda c: X.retrieval_metrics(bm25(c), relevant(c), "doc_id").join(asked(c).select("query_id", F.size(X.tokens(F.col("text"))).alias("n")), "query_id").groupBy(
        F.when(F.col("n") <= 3, "1-3").when(F.col("n") <= 10, "4-10").when(F.col("n") <= 25, "11-25").otherwise("26+").alias("bucket")
    ).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))
)
#: Retrievers by name: (tables, k) to (query_id, doc_id, score, rank). Further ones may be added.
RETRIEVERS = {"bm25": bm25, "expansion": expanded, "dense": dense, "hybrid": hybrid, "hybrid_expansion": hybrid_expanded}
_ALL = {
    "bm25": "(SELECT * FROM bm WHERE rank <= 10)",
    "expansion": "(SELECT * FROM bx WHERE rank <= 10)",
    "hybrid_expansion": "hx",
    "dense": "(SELECT * FROM dn WHERE rank <= 10)",
    "hybrid": "hy",
}
_HX = f"ux AS (SELECT query_id, doc_id, rank FROM bx UNION ALL SELECT query_id, doc_id, rank FROM dn), fx AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM ux GROUP BY 1, 2), hx AS ({_top('fx', 10)})"
query("i23_methods", f"WITH {_HYB}, {_EXP}, {_TAIL.replace('rank <= 10', 'rank <= 30')}, {_HX}, {_PER} " + " UNION ALL ".join(f"SELECT '{n}' AS method, count(*) AS queries, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(reciprocal_rank), 5) AS mrr FROM ({_metrics(s)})" for n, s in _ALL.items()))(
    lambda c: reduce(lambda a, b: a.unionByName(b), (X.retrieval_metrics(f(c, 10), relevant(c), "doc_id").agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 5).alias("precision"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("reciprocal_rank"), 5).alias("mrr")).select(F.lit(n).alias("method"), "*") for n, f in RETRIEVERS.items()))
)
