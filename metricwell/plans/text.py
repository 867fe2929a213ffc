"""Queries of groups I, J and L: text, retrieval, evidence and logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import text as X
from ..operators import kpi as K
from ..operators.index import TermIndex, terms_of
from .sql import Registry

query = Registry()
_ALL_TOK = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}][\p{L}\p{M}\p{N}_]*'), lambda x: length(x) >= 2)"
_TOK = f"list_filter({_ALL_TOK}, lambda x: x NOT IN {X.STOP_WORDS})"
_POST = f"tok AS (SELECT doc_id, {_TOK} AS w FROM documents), post AS (SELECT doc_id, term, len AS dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL)"


def words(c):
    """The tokens of all documents, written once for a query."""
    return c.stored("words", lambda: X.tokenized(c.raw("documents")))


def index(c):
    """The kept index of all documents: its two segments (the documents of one language come later) are built by the first query that asks."""

    def build():
        docs, late = c.raw("documents"), F.coalesce(F.col("lang") == "fr", F.lit(False))
        return TermIndex.of_table(docs).add(docs.where(~late), name="first").add(docs.where(late), name="late")

    return c.kept("index", build)


def asked(c):
    return c.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")


query("i2_tokenize", f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS w FROM documents)")(
    lambda c: c.raw("documents").select("doc_id", X.tokens(X.nfkc(F.col("text"))).alias("w")).select(
        "doc_id",
        F.size("w").cast("long").alias("n_tokens"),
        F.md5(F.array_join("w", " ").cast("binary")).alias("digest"),
    )
)
query("i4_postings", f"WITH {_POST} SELECT * FROM post")(lambda c: index(c).postings().drop("shard", "segment"))
query("i6_index_stats", f"WITH {_POST} SELECT (SELECT count(*) FROM tok) AS documents, (SELECT count(DISTINCT term) FROM post) AS vocabulary, (SELECT round(avg(len(w)), 6) FROM tok) AS avg_length")(lambda c: index(c).stats())
_QT = _TOK.replace("text", "q.text")
_BM25 = f"""{_POST}, qt AS (SELECT DISTINCT item_id AS query_id, unnest({_QT}) AS term FROM benchmark q), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    sc AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 1)), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc) WHERE rank <= 10)"""


def bm25(c, k=10):
    """BM25+ of the benchmark's texts over all documents, written once for each k."""
    return c.stored(f"bm25 {k}", lambda: index(c).top(terms_of(asked(c)), k))


query("i5_bm25", f"WITH {_BM25} SELECT * FROM bm")(bm25)
#: Each query searches the documents of one language only, which its number chooses.
_LANGS = ("de", "en", "es", "fr")
_OWN = f"lang = {[*_LANGS]}[1 + query_id % 4]"
query("i5_candidate_subsets", f"WITH {_BM25}, own AS (SELECT sc.* FROM sc JOIN documents USING (doc_id) WHERE {_OWN}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM own) WHERE rank <= 10")(
    lambda c: index(c).top(terms_of(asked(c)), 10, subsets(c))
)


def subsets(c):
    """(query_id, doc_id): the documents that each query may find."""
    own = F.element_at(F.array(*map(F.lit, _LANGS)), (1 + F.col("query_id") % 4).cast("int"))
    return asked(c).select("query_id", own.alias("lang")).join(c.raw("documents").select("doc_id", "lang"), "lang").select("query_id", "doc_id")


_COS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"


def cosine(c, k=10):
    v = c.raw("embeddings")
    return X.cosine_top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


query("i7_cosine_top_k", _COS)(cosine)


@query("i7_candidate_subsets", _COS.replace("% 20 = 0", "% 20 = 0 AND v.vec_id % 7 = q.vec_id % 7"))
def _cosine_among(c):
    """Each query searches the vectors of its own seventh."""
    v = c.raw("embeddings")
    asking = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    own = asking.select("query_id", F.expr("query_id % 7").alias("part")).join(v.select("vec_id", F.expr("vec_id % 7").alias("part")), "part")
    return X.cosine_among(c.stored("candidates", lambda: own.select("query_id", "vec_id")), v, asking, 10)


query(
    "i9_rank_fusion",
    f"WITH {_BM25}, l AS (SELECT query_id, doc_id, rank FROM bm UNION ALL "
    "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INTEGER "
    "FROM bm), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM l GROUP BY 1, 2) SELECT * "
    "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f) WHERE rank <= 5",
)(
    lambda c: (
        lambda b: X.fuse(b, b.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))), key="doc_id", k=5)
    )(bm25(c))
)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')"
_NAMES = f"list_distinct(list_filter({_WORDS}, lambda x: regexp_matches(x, '{X.NAME}') AND x NOT IN {X.NOT_NAMES}))"
_KINDS = {n: f"regexp_matches(text, '{p}')" for n, p in X.PII.items()} | {
    "address": f"regexp_matches(text, '{X.ADDRESS}')",
    "name_heuristic": f"len({_NAMES}) >= 2",
}
PII_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in sorted(_KINDS.items())) + "], lambda x: x IS NOT NULL), ',')"
SAFETY_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"coalesce(regexp_matches(text, '{p}'), false)" for p in patterns)} THEN '{label}'" for label, patterns in (("BLOCKED", X.BLOCKED), ("SUSPICIOUS", X.SUSPICIOUS))
) + " ELSE 'SAFE' END"
query("i15_pii_types", f"SELECT doc_id, {PII_SQL} AS pii FROM documents")(
    lambda c: c.raw("documents").select("doc_id", F.array_join(X.pii_types(F.col("text")), ",").alias("pii"))
)
_RED = "text"
for _n, _p in sorted(X.PII.items()):
    _RED = f"regexp_replace({_RED}, '{_p}', '[REDACTED_{_n.upper()}]', 'g')"
query("i16_pii_redaction", f"SELECT doc_id, md5({_RED}) AS digest, length({_RED}) AS chars FROM documents")(
    lambda c: c.raw("documents").select("doc_id", X.redact(F.col("text")).alias("t")).select(
        "doc_id",
        F.md5(F.col("t").cast("binary")).alias("digest"),
        F.length("t").cast("long").alias("chars"),
    )
)
_HELD = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{p}' END" for p in (*X.BLOCKED, *X.SUSPICIOUS)) + "], lambda x: x IS NOT NULL), ' ; ')"
query("i17_safety", f"SELECT doc_id, {SAFETY_SQL} AS safety, coalesce({_HELD}, '') AS patterns FROM documents")(
    lambda c: c.raw("documents").select("doc_id", X.safety(F.col("text")).alias("safety"), F.array_join(X.matched_patterns(F.col("text")), " ; ").alias("patterns"))
)
_MEASURES = ", ".join(f"{e.format(c)} AS {n}_{c}" for c in ("chars", "words") for n, e in (("mean", "round(avg({}), 6)"), ("median", "median({})"), ("p90", "round(quantile_cont({}, 0.9), 6)"), ("max", "max({})")))
_SEEN = ", ".join(f"count(*) FILTER (seen AND {p}) AS {k}" for k, p in sorted(_KINDS.items()))
_REPORT = f"""x AS (SELECT text, trim(coalesce(text, '')) <> '' AS seen, CASE WHEN seen THEN length(text) END AS chars, CASE WHEN seen THEN len(regexp_extract_all(text, '[^\\s]+')) END AS words, trim(coalesce(source, '')) <> '' AS titled FROM documents),
    sh AS (SELECT text, count(*) AS n FROM x WHERE seen GROUP BY 1 HAVING count(*) > 1)"""
query(
    "i19_text_quality",
    f"WITH {_REPORT} SELECT count(*) AS rows, count(*) FILTER (titled) AS with_title, count(*) FILTER (seen) AS with_text, round(avg((NOT seen)::INTEGER), 6) AS empty_share, {_MEASURES}, "
    f"count(*) FILTER (words <= {X.SHORT_WORDS}) AS short, count(*) FILTER (words >= {X.LONG_WORDS}) AS long, {_SEEN}, count(*) FILTER (seen AND regexp_matches(text, '{X.HTML}')) AS html, "
    f"count(*) FILTER (seen AND {SAFETY_SQL} <> 'SAFE') AS injection, (SELECT count(*) FROM sh) AS duplicate_texts, (SELECT coalesce(sum(n), 0)::BIGINT FROM sh) AS duplicate_rows FROM x",
)(lambda c: X.text_report(c.raw("documents"), title="source")[0])
query("i19_repeated_texts", f"WITH {_REPORT} SELECT md5(text) AS digest, n FROM sh ORDER BY n DESC, text LIMIT 5")(
    lambda c: X.text_report(c.raw("documents"), title="source")[1].select(F.md5(F.col("t").cast("binary")).alias("digest"), "n")
)
_REL = "rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


#: Inner words of an item, at most, by which documents are looked up before its whole text is compared.
ANCHOR = 5
#: Bitmaps of 32,768 bits that tell which hashes of anchors there are: 256 KB in all, whatever the number of items.
MARKS = 64


def relevant(c):
    """Documents that contain a benchmark text.

    An item is looked up by the hash of a run of its inner words, which stand in a document as whole words too. Windows of
    documents are held against bitmaps of these hashes before they leave their row, so that few are exploded and joined.
    Items of one or two words have no inner word and are compared with all documents.
    """
    split = lambda t: F.split(F.trim(t, F.lit(" \t\n\x0b\f\r")), r"[ \t\n\x0b\f\r]+")
    key = lambda w, at, n: F.xxhash64(F.lit(n) if isinstance(n, int) else n, F.array_join(F.slice(w, at, n), " "))
    items = c.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"), split(F.col("text")).alias("w")).where("q IS NOT NULL")
    n = F.least(F.lit(ANCHOR), F.size("w") - 2)
    long = items.where(F.size("w") >= 3).select("query_id", "q", n.alias("n"), key(F.col("w"), F.lit(2), n).alias("anchor"))
    place, bit = lambda h: F.shiftright(h, 15).bitwiseAND(F.lit(MARKS - 1)).cast("int"), lambda h: h.bitwiseAND(F.lit(32767))
    maps = long.groupBy(place(F.col("anchor")).alias("at")).agg(F.bitmap_construct_agg(bit(F.col("anchor"))).alias("bits"))
    marks = maps.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda i: F.try_element_at("m", i)).alias("marks"))

    def marked(h):
        byte = F.conv(F.hex(F.substring(F.get("marks", place(h)), F.floor(bit(h) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (bit(h) % 8).cast("int")) == 1, F.lit(False))

    sizes = [r["n"] for r in long.select("n").distinct().collect()]  # 1 to ANCHOR
    docs = c.raw("documents").select("doc_id", split(F.col("text")).alias("w")).crossJoin(F.broadcast(marks))
    windows = lambda k: F.when(F.size("w") >= k, F.filter(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: key(F.col("w"), i, k)), marked))
    at = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*map(windows, sizes)))))).alias("anchor")) if sizes else None
    rest = c.raw("documents").join(items.where(F.size("w") < 3), F.contains("text", "q")).select("query_id", "doc_id")
    if at is None:
        return rest
    found = at.join(long.select("query_id", "q", "anchor"), "anchor").select("query_id", "doc_id", "q").distinct()
    sure = found.join(c.raw("documents").select("doc_id", "text"), "doc_id").where(F.contains("text", "q"))
    return sure.select("query_id", "doc_id").unionByName(rest)


#: Queries by the length of their text, as a category.
_CATEGORY = f"CASE WHEN len({_QT}) <= 10 THEN 'short' WHEN len({_QT}) <= 25 THEN 'medium' ELSE 'long' END"
query(
    "i21_retrieval_metrics",
    f"WITH {_BM25}, {_REL}, w AS (SELECT query_id, count(*) AS relevant FROM rel " "GROUP BY 1), p AS (SELECT query_id, count(*) AS returned, count(rel.doc_id) AS hits, min(CASE " "WHEN rel.doc_id IS NOT NULL THEN rank END) AS f FROM bm LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1) " "SELECT query_id, round(hits / returned::DOUBLE, 6) AS precision, round(hits / relevant::DOUBLE, 6) AS recall, round(coalesce(1 / f::DOUBLE, 0), 6) AS reciprocal_rank " "FROM p JOIN w USING (query_id)",
)(lambda c: X.retrieval_metrics(bm25(c), relevant(c), "doc_id"))

# J: evidence
_EV = "SELECT 'ev_kpi_' || substr(sha256('revenue|' || month || '|' || sample_size), 1, 16) AS evidence_id, month, printf('revenue in %s from %d items', month, sample_size) AS claim FROM (SELECT month, count(*) AS sample_size FROM kpi_items GROUP BY 1)"


def evidence(c):
    rows = K.Kpi(c, window=False).items([]).groupBy("month").agg(F.count("*").alias("sample_size"))
    return rows.select(
        F.concat(F.lit("ev_kpi_"), F.substring(F.sha2(F.concat_ws("|", F.lit("revenue"), "month", "sample_size"), 256), 1, 16)).alias("evidence_id"),
        "month",
        F.format_string("revenue in %s from %d items", "month", "sample_size").alias("claim"),
    )


query("j1_evidence_ids", _EV)(evidence)
_Z = "SELECT coalesce(lang, '') AS category, count(*) FILTER (r < 500) AS n1, count(*) FILTER (r < 500 AND s <= 2) AS x1, count(*) FILTER (r >= 500) AS n2, count(*) FILTER (r >= 500 AND s <= 2) AS x2 FROM (SELECT lang, review_row_id % 1000 AS r, review_score AS s FROM fact_reviews) GROUP BY 1"
query("j10_low_score_contradiction", f"SELECT *, round((x2 / n2::DOUBLE - x1 / n1::DOUBLE) / nullif(sqrt((x1 + x2) / (n1 + n2)::DOUBLE * (1 - (x1 + x2) / (n1 + n2)::DOUBLE) * (1 / n1::DOUBLE + 1 / n2::DOUBLE)), 0), 6) AS z, x2 / n2::DOUBLE <= x1 / n1::DOUBLE AS contradicts FROM ({_Z}) WHERE n1 >= 15 AND n2 >= 15")(
    lambda c: c.fact_reviews.selectExpr("coalesce(lang, '') AS category", "review_row_id % 1000 AS r", "review_score AS s").groupBy("category").agg(
        F.count_if(F.expr("r < 500")).alias("n1"),
        F.count_if(F.expr("r < 500 AND s <= 2")).alias("x1"),
        F.count_if(F.expr("r >= 500")).alias("n2"),
        F.count_if(F.expr("r >= 500 AND s <= 2")).alias("x2"),
    ).where("n1 >= 15 AND n2 >= 15") .withColumn(
        "z", F.expr("round((x2 / n2 - x1 / n1) / nullif(sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 0), 6)")
    ).withColumn("contradicts", F.expr("x2 / n2 <= x1 / n1"))
)
query("j14_redact_ids", r"SELECT doc_id, md5(regexp_replace(text, '(?i)\b[0-9a-f]{16,64}\b', '[ID]', 'g')) AS digest FROM documents")(
    lambda c: c.raw("documents").select("doc_id", F.md5(F.regexp_replace("text", r"(?i)\b[0-9a-f]{16,64}\b", "[ID]").cast("binary")).alias("digest"))
)

# L: logs
query("l17_state_fold", "SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS first_event, last(event_id ORDER BY ts, event_id) AS last_event, last(value ORDER BY ts, event_id) FILTER (value IS NOT NULL) AS value, count(*) AS events FROM events GROUP BY 1, 2")(
    lambda c: c.raw("events").groupBy("user_id", "event_type").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("value"),
        F.count("*").alias("events"),
    )
)
query("l26_audit_log", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC")(
    lambda c: c.raw("events").where("event_type = 'error'").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id"))
)
query("l27_telemetry", "SELECT user_id::VARCHAR AS user_id, event_type, grouping_id(user_id, event_type) AS level, count(*) AS calls, round(sum(value), 4) AS latency FROM events GROUP BY ROLLUP (user_id, event_type)")(
    lambda c: c.raw("events").withColumn("user_id", F.col("user_id").cast("string")).rollup("user_id", "event_type").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("calls"),
        F.round(F.sum("value"), 4).alias("latency"),
    )
)
query("m2_events_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda c: c.raw("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
)
