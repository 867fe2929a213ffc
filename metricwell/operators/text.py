"""Text: tokens, BM25+, cosine search, rank fusion, personal data and safety."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kpi import CLEARANCE
from .skew import join_hot

#: BM25+ parameters and the constant of rank fusion.
K1, B, DELTA, RRF_K = 1.5, 0.75, 1.0, 60
#: Queries that meet a batch of vectors in one step of the exact search.
BLOCK = 256
# Patterns of personal data, of addresses and names, and words that begin sentences rather than names.
PII = {
    "email": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+",
    "phone": r"(?:\+?55[\s.-]?)?\(?\d{2}\)?[\s.-]?9?\d{4}[\s.-]?\d{4}\b",
    "url": r"https?://\S+|www\.\S+",
}
ADDRESS = r"\b\d{5}-?\d{3}\b|(?i:(?:^|[^\p{L}\p{N}_])(?:(?:rua|avenida|alameda|rodovia)(?:$|[^\p{L}\p{N}_])|av\.[\p{L}\p{N}_]))"
NAME = r"^[A-ZÀ-Ú][a-zà-ú]{2,}$"
NOT_NAMES = (
    "Muito", "Bom", "Boa", "Ótimo", "Otimo", "Excelente", "Recomendo", "Produto", "Entrega", "Chegou", "Compra",
    "Comprei", "Loja", "Obrigado", "Obrigada", "Não", "Nao", "Ainda", "Todo", "Toda", "Depois", "Quando", "Porém", "Porem",
)
# Text that gives orders to a model (blocked), and what is only odd by itself (suspicious).
BLOCKED = (
    r"(?i)ignore (all|the|any|your)? ?(previous|prior|above)? ?instructions?",
    r"(?i)disregard (the|your|all)? ?(system|previous|prior)? ?(prompt|instructions?)",
    r"(?i)reveal (the|your) (system prompt|instructions?|api key|password|database)",
    r"(?i)forget (the|this) investigation",
    r"(?i)\bexecute\b.{0,20}\b(command|code|script)\b",
    r"(?i)\bgive me all\b.{0,20}\b(customer|password|email)s?\b",
)
SUSPICIOUS = (r"(?i)\byou are now\b", r"(?i)\bact as (an?|the)\b", r"(?i)^\s*system\s*:")
# Words without meaning of their own, in two languages.
STOP_WORDS = tuple(
    """a à ao as às de do da dos das e é em no na nos nas o os um uma uns umas que se ou por para com não mais mas me te
    lhe vos lhes eu tu ele ela nós vós eles elas esse essa esses essas este esta estes estas aquele aquela aqueles
    aquelas isso isto aquilo muito bem já só até the an in on at to of and or is was are were be been being have has had
    does did will would should could not it its i you he she we they""".split()
)


# Concepts and the words that stand for them.
SYNONYMS = {
    "delivery": ("entrega", "envio", "prazo", "demorou", "atraso", "atrasado", "demora", "demorado", "chegou", "recebimento"),
    "entrega": ("delivery", "envio", "prazo", "demorou", "atraso", "atrasado", "demora", "chegou"),
    "atraso": ("atrasado", "demorou", "demora", "demorado", "prazo", "passou", "delay", "late"),
    "demora": ("demorou", "demorado", "atraso", "atrasado", "prazo", "delay"),
    "envio": ("entrega", "enviar", "shipped", "shipping", "postagem"),
    "quality": ("qualidade", "defeito", "quebrado", "estragado", "danificado", "defeituoso", "problema"),
    "qualidade": ("quality", "defeito", "defeituoso", "danificado", "estragado"),
    "defeito": ("defeituoso", "danificado", "quebrado", "estragado", "falha", "defective", "broken", "damaged"),
    "quebrado": ("quebrada", "quebrou", "defeito", "danificado", "broken"),
    "estragado": ("estragada", "estragou", "defeito", "danificado", "broken"),
    "péssimo": ("horrível", "ruim", "terrível", "decepcionante", "worst", "terrible", "awful"),
    "horrível": ("péssimo", "ruim", "terrível", "awful", "horrible"),
    "ótimo": ("excelente", "perfeito", "maravilhoso", "great", "excellent"),
    "excelente": ("ótimo", "perfeito", "maravilhoso", "excellent", "great", "outstanding"),
}


def synonym_table(spark) -> DataFrame:
    """SYNONYMS as rows (term, synonym)."""
    return spark.createDataFrame([(t, s) for t, more in SYNONYMS.items() for s in more], "term string, synonym string")


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words that begin with a letter, of two characters or more, without stop words.

    For texts with compatibility characters give nfkc(text).
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[^\W\d_]\w*"), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(*stop) if stop else F.length(x) >= 2)


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, w): the tokens of every text, for what reads them more than once."""
    return docs.select(key, tokens(F.col(text)).alias("w"))


def _packed(df: DataFrame, key: str, name: str) -> DataFrame:
    """(dims, name): the vectors of an Arrow batch as the bytes of ids and of unit rows; lengths of zero stay zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = np.asarray(batch.column(0), dtype=np.int64), batch.column(1)
            width = np.diff(np.asarray(values.offsets))
            flat, start = np.asarray(values.flatten(), dtype=np.float64), np.asarray(values.offsets)[:-1] - values.offsets[0].as_py()
            for d in np.unique(width).tolist():
                rows = np.flatnonzero(width == d)
                m = flat[start[rows][:, None] + np.arange(d)]
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d], pa.int32()),
                        pa.array([{"ids": ids[rows].tobytes(), "m": m.tobytes()}], pa.struct([("ids", pa.binary()), ("m", pa.binary())])),
                    ],
                    ["dims", name],
                )

    return df.where("embedding IS NOT NULL").select(
        F.col(key).cast("long").alias(key),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).mapInArrow(run, f"dims int, {name} struct<ids: binary, m: binary>")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine search; vectors of length zero score 0.

    Both sides are packed into matrices, one for each Arrow batch; each pair of a batch of vectors and one of queries is
    a product of matrices, of which only the k best of every query go on. Batches are dealt to the rows and columns of a
    grid, whose cells are the keys of the join, about as many as there are shuffle partitions. Vectors of different
    lengths don't meet.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high, wide = max(1, round(2 * parts**0.5)), max(1, round(0.5 * parts**0.5))  # more rows, as there are more vectors
    dealt = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(vectors, "vec_id", "v").select("dims", "v", dealt("v.ids", high).alias("i"), each(wide).alias("j"))
    right = _packed(queries, "query_id", "q").select("dims", "q", dealt("q.ids", wide).alias("j"), each(high).alias("i"))
    pairs = left.join(right, ["dims", "i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dims"]
                ids, v = np.frombuffer(row["v"]["ids"], np.int64), np.frombuffer(row["v"]["m"]).reshape(-1, d)
                asking, q = np.frombuffer(row["q"]["ids"], np.int64), np.frombuffer(row["q"]["m"]).reshape(-1, d)
                for at in range(0, len(asking), BLOCK):
                    scores = np.round(q[at : at + BLOCK] @ v.T, 6)
                    best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(asking[at : at + BLOCK], best.shape[1])),
                            pa.array(ids[best].ravel()),
                            pa.array(np.take_along_axis(scores, best, 1).ravel()),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_among(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """cosine_top_k where each query has its own candidates (query_id, vec_id): only their products are computed."""
    unit = lambda e: F.transform(e, lambda x: x / F.greatest(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-30)))
    side = lambda df, key, name: df.where("embedding IS NOT NULL").select(key, unit(F.col("embedding").cast("array<double>")).alias(name))
    pairs = join_hot(candidates, side(vectors, "vec_id", "v"), ["vec_id"]).join(side(queries, "query_id", "q"), "query_id")
    pairs = pairs.where(F.size("v") == F.size("q"))
    score = F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(*rankings: DataFrame, key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, key, rank)."""
    every = rankings[0].select("query_id", key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", key, "rank"))
    fused = every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def names(text: Column) -> Column:
    """The distinct words that look like names: capitalised, and none that begins sentences."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda x: x.rlike(NAME) & ~x.isin(*NOT_NAMES)))


def pii_kinds(text: Column) -> dict[str, Column]:
    """By kind of personal data whether a text holds it: address, email, name_heuristic (two names or more), phone, url."""
    held = {name: text.rlike(p) for name, p in PII.items()}
    held["email"] = text.contains("@") & held["email"]  # most texts hold none, which a search for one sign tells
    kinds = held | {"address": text.rlike(ADDRESS), "name_heuristic": F.size(names(text)) >= 2}
    return dict(sorted(kinds.items()))


def pii_types(text: Column) -> Column:
    """Sorted names of the kinds of personal data found."""
    return F.array_compact(F.array(*(F.when(found, name) for name, found in pii_kinds(text).items())))


def redact(text: Column) -> Column:
    """Emails, phones and urls replaced by [REDACTED_KIND], kind by kind in order; other kinds are no single span."""
    for name, p in sorted(PII.items()):
        text = F.regexp_replace(text, p, f"[REDACTED_{name.upper()}]")
    return text


def safety(text: Column) -> Column:
    """BLOCKED before SUSPICIOUS before SAFE; null is SAFE."""
    out = F.lit("SAFE")
    for label, patterns in (("SUSPICIOUS", SUSPICIOUS), ("BLOCKED", BLOCKED)):
        for p in patterns:
            out = F.when(text.rlike(p), label).otherwise(out)
    return out


def matched_patterns(text: Column) -> Column:
    """Every pattern of BLOCKED and SUSPICIOUS, in this order, that a text holds."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), p) for p in (*BLOCKED, *SUSPICIOUS))))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """precision (of the returned), recall and reciprocal rank of each query. relevant: (query_id, key)."""
    marked = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", key], "left")
    per = marked.groupBy("query_id").agg(
        F.count("*").alias("returned"),
        F.count("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = per.join(wanted, "query_id")
    return out.select(
        "query_id",
        F.round(F.try_divide("hits", "returned"), 6).alias("precision"),
        F.round(F.try_divide("hits", "relevant"), 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(F.lit(1), "first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


# Frequent words by which a language is guessed.
WORDS = {
    "de": ("der", "die", "und", "das", "ist", "zu", "den"),
    "en": ("the", "of", "and", "is", "that", "with", "on"),
    "es": ("el", "los", "que", "de", "del", "las", "con"),
    "fr": ("le", "les", "et", "pour", "dans", "pas", "que"),
}
DIMENSION, MMR = 64, 0.7
#: Words up to which a text is short, and from which it is long; what looks like markup.
SHORT_WORDS, LONG_WORDS = 2, 100
HTML = r"<[a-zA-Z][^>]*>|&[a-z]{2,6};"


def nfkc(text: Column) -> Column:
    """Compatibility characters in their plain form; Spark has no function of its own for it. ASCII stays in the JVM."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.coalesce(plain(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def joined_title(title: Column, message: Column) -> Column:
    """The parts that are not blank, with a blank between them; null if both are blank."""
    parts = F.filter(F.array(title, message), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, " "))


def normalise(text: Column) -> Column:
    """NFKC and single blanks. Null stays null."""
    return F.trim(F.regexp_replace(nfkc(text), r"\s+", " "))


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, term, original): the distinct tokens of each query and the synonyms of these. synonyms: (term, synonym)."""
    own = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    more = own.join(synonyms, "term").select("query_id", F.col("synonym").alias("term")).distinct().join(own, ["query_id", "term"], "left_anti")
    return own.withColumn("original", F.lit(True)).unionByName(more.withColumn("original", F.lit(False)))


def _bucket(term: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(DIMENSION))


def hash_buckets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, bucket, n): feature hashing of the tokens, the embedding that needs no model."""
    return docs.select(
        key,
        F.explode(tokens(F.col(text))).alias("term"),
    ).groupBy(key, _bucket(F.col("term")).alias("bucket")).agg(F.count("*").alias("n"))


def hash_vectors(words: DataFrame, key: str, empty: bool = False) -> DataFrame:
    """(key, embedding) of tokenized texts by feature hashing, without a shuffle; texts without a token have none, or zeros if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column("b")
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(buckets.offsets)))
            n = np.bincount(row * DIMENSION + np.asarray(buckets.flatten()), minlength=len(batch) * DIMENSION).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * DIMENSION, pa.array(n))],
                [key, "embedding"],
            )

    rows = (words if empty else words.where(F.size("w") > 0)).select(key, F.transform("w", _bucket).alias("b"))
    return rows.mapInArrow(run, f"{key} {dict(words.dtypes)[key]}, embedding array<double>")


def unseen(docs: DataFrame, stored: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(key, text): the distinct texts whose key (text, model) is not among stored keys."""
    keyed = docs.where(F.col(text).isNotNull()).select(F.sha2(F.concat_ws("|", text, F.lit(model)), 256).alias("key"), text)
    return keyed.groupBy("key").agg(F.any_value(text).alias(text)).join(stored.select("key"), "key", "left_anti")


def embed(docs: DataFrame, provider, key: str = "key", text: str = "text") -> DataFrame:
    """(key, embedding) by a caller's provider, made once per batch stream: provider() gives a function from texts to lists."""

    def run(batches):
        model = provider()
        for b in batches:
            yield b[[key]].assign(embedding=list(model(b[text].fillna("").tolist())))

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, embedding array<double>")


def rerank(pairs: DataFrame, scorer, k: int, key: str = "doc_id") -> DataFrame:
    """The k best of each query by a caller's scorer of (query, text) pairs. pairs: query_id, key, query, text."""

    def run(batches):
        model = scorer()
        for b in batches:
            yield b[["query_id", key]].assign(score=[float(x) for x in model(list(zip(b["query"], b["text"], strict=True)))])

    scored = pairs.mapInPandas(run, f"query_id long, {key} long, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def mmr(pool: DataFrame, k: int, weight: float = MMR, key: str = "doc_id") -> DataFrame:
    """(query_id, key, rank): maximal marginal relevance over each query's bounded pool (query_id, key, score, embedding).

    Relevance is weighed against the largest similarity to what is taken already; ties keep the order of the pool.
    """

    def run(rows):
        rows = rows.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.array(rows["embedding"].tolist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
        relevance, near, taken = rows["score"].to_numpy(), np.zeros(len(rows)), []
        free = np.ones(len(rows), bool)
        while free.any() and len(taken) < k:
            worth = np.where(free, np.round(weight * relevance - (1 - weight) * near, 9), -np.inf)
            i = int(worth.argmax())
            near = v @ v[i] if not taken else np.maximum(near, v @ v[i])
            free[i] = False
            taken.append(i)
        return rows.iloc[taken][["query_id", key]].assign(rank=np.arange(1, len(taken) + 1))

    return pool.groupBy("query_id").applyInPandas(run, f"query_id long, {key} long, rank int")


def diversify(ranked: DataFrame, group: str, k: int, key: str = "doc_id") -> DataFrame:
    """Round robin over the values of group, in the order in which they first appear."""
    within = Window.partitionBy("query_id", group)
    out = ranked.withColumn("turn", F.row_number().over(within.orderBy("rank"))).withColumn("best", F.min("rank").over(within))
    return out.withColumn(
        "new_rank",
        F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "best")),
    ).where(F.col("new_rank") <= k).select("query_id", key, group, F.col("new_rank").alias("rank"))


def structured(equal: dict[str, str] | None = None, score_min: int | None = None, score_max: int | None = None, months: tuple[str, str] | None = None, clearance: str = "RESTRICTED") -> Column:
    """The reviews that filters let through, by their metadata (review_score, month, seller_id, security_status ...).

    equal: columns and their values; a null never equals. Reviews without a month pass the range of months. BLOCKED texts
    never pass, and below INTERNAL no review that names a seller does.
    """
    out = F.col("security_status") != "BLOCKED"
    for name, value in (equal or {}).items():
        out = out & F.coalesce(F.col(name) == value, F.lit(False))
    if score_min is not None:
        out = out & (F.col("review_score") >= score_min)
    if score_max is not None:
        out = out & (F.col("review_score") <= score_max)
    if months:
        out = out & F.coalesce(F.col("month").between(*months), F.lit(True))
    if CLEARANCE[clearance] < CLEARANCE["INTERNAL"]:
        out = out & F.col("seller_id").isNull()
    return out


#: Filters that a search gives up, one after another, before it turns to vectors.
GIVEN_UP = ("category", "seller_state", "customer_state", "score_min", "score_max")


def relaxed(filters: dict) -> list[tuple[str, dict]]:
    """(name, filters) of the steps in which filters are given up; those of equality and the bounds are keys alike."""
    out, left = [], dict(filters)
    for name in GIVEN_UP:
        if name in left:
            left = {k: v for k, v in left.items() if k != name}
            out.append((f"dropped_{name}", left))
    return out


def allowed(filters: dict, clearance: str = "RESTRICTED") -> Column:
    """structured for filters in one dictionary."""
    own = ("score_min", "score_max", "months")
    return structured({k: v for k, v in filters.items() if k not in own}, **{k: v for k, v in filters.items() if k in own}, clearance=clearance)


def ladder(queries: DataFrame, rungs: list[tuple[str, DataFrame, float]], among: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, rung, best, candidates, coverage): the first rung whose best score reaches its floor, or insufficient.

    rungs: name, ranking (query_id, score) and floor, words first and vectors last. An insufficient search names the best
    score by words, 0 without any, and how many candidates of the corpus the filters had left.
    """
    out, rung, best = queries.select("query_id").distinct(), F.lit("insufficient"), F.lit(None).cast("double")
    for i, (_, ranking, _) in enumerate(rungs):
        out = out.join(ranking.groupBy("query_id").agg(F.max("score").alias(f"s{i}")), "query_id", "left")
    for i, (name, _, floor) in reversed(list(enumerate(rungs))):
        rung, best = F.when(F.col(f"s{i}") >= floor, name).otherwise(rung), F.when(F.col(f"s{i}") >= floor, F.col(f"s{i}")).otherwise(best)
    sizes = among.agg(F.count("*").alias("few")).crossJoin(F.broadcast(corpus.agg(F.count("*").alias("all"))))
    lacking = rung == "insufficient"
    return out.crossJoin(F.broadcast(sizes)).select(
        "query_id",
        rung.alias("rung"),
        F.when(lacking, F.coalesce(F.greatest("s0", "s1"), F.lit(0.0))).otherwise(best).alias("best"),
        F.when(lacking, F.col("few")).alias("candidates"),
        F.when(lacking, F.round(F.try_divide("few", "all"), 6)).alias("coverage"),
    )


def _one_of(values: tuple[str, ...]):
    return lambda x: x.isin(*values)


def language(text: Column) -> Column:
    """UNKNOWN under ten characters or without a known word, else the language with most known words (ties by name).

    The words are found once and counted once: a lambda's argument is computed before its body, however often that names it.
    """
    known = F.transform(F.array(tokens(text, ())), lambda w: F.filter(w, _one_of(tuple(sorted({x for v in WORDS.values() for x in v})))))
    counted = F.transform(known, lambda w: F.struct(*(F.size(F.filter(w, _one_of(v))).alias(k) for k, v in WORDS.items())))

    def named(n: Column) -> Column:
        most = F.greatest(*(n[k] for k in WORDS))
        out = F.lit("UNKNOWN")
        for k in reversed(sorted(WORDS)):
            out = F.when(n[k] == most, k).otherwise(out)
        return F.when(most == 0, "UNKNOWN").otherwise(out)

    found = F.get(F.transform(counted, named), F.lit(0))
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 10, "UNKNOWN").otherwise(found)


def pii_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column, kind, n): values of every string column that look like personal data of each kind.

    Columns are found in the schemas; a table is read once, for all its columns and kinds.
    """
    out = None
    for name, df in tables.items():
        found = [(c, kind, test) for c, t in df.dtypes if t == "string" for kind, test in pii_kinds(F.col(f"`{c}`")).items()]
        if not found:
            continue
        parts = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count_if(test).alias("n")) for c, kind, test in found]
        rows = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def text_report(docs: DataFrame, text: str = "text", title: str = "title", top: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row about all texts, and the texts that most rows share (n rows each, ties by text).

    Lengths are those of texts that are not blank. Short: at most SHORT_WORDS words, long: at least LONG_WORDS.
    duplicate_texts counts texts that several rows share, duplicate_rows the rows that hold them.
    """
    t = F.col(text)
    seen = F.trim(F.coalesce(t, F.lit(""))) != ""
    words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    rows = docs.select(t.alias("t"), seen.alias("seen"), F.when(seen, F.length(t)).alias("chars"), F.when(seen, words).alias("words"), (F.trim(F.coalesce(title, F.lit(""))) != "").alias("titled"))
    held = {kind: F.count_if(F.col("seen") & test) for kind, test in (pii_kinds(F.col("t")) | {"html": F.col("t").rlike(HTML), "injection": safety(F.col("t")) != "SAFE"}).items()}
    measures = [f(F.col(c)).alias(f"{n}_{c}") for c in ("chars", "words") for n, f in (("mean", lambda x: F.round(F.avg(x), 6)), ("median", F.median), ("p90", lambda x: F.round(F.percentile(x, F.lit(0.9)), 6)), ("max", F.max))]
    one = rows.agg(
        F.count("*").alias("rows"), F.count_if("titled").alias("with_title"), F.count_if("seen").alias("with_text"), F.round(F.avg((~F.col("seen")).cast("int")), 6).alias("empty_share"), *measures,
        F.count_if(F.col("words") <= SHORT_WORDS).alias("short"), F.count_if(F.col("words") >= LONG_WORDS).alias("long"), *(v.alias(k) for k, v in held.items()),
    )
    shared = rows.where("seen").groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    twice = shared.agg(F.count("*").alias("duplicate_texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    return one.crossJoin(F.broadcast(twice)), shared.orderBy(F.desc("n"), "t").limit(top)


def embed_new(docs: DataFrame, path: str, run: int, model: str, embedder, text: str = "text") -> None:
    """Embeds the distinct texts whose key no earlier run has stored at path, and stores them as this run.

    embedder: rows (key, text) to (key, embedding), one for each. A run writes under its own number and reads the lower
    ones only, so that one repeated after a failure replaces what it wrote, and the store never holds a key twice.
    """
    keys = "key string, embedding array<double>, run int"
    spark = docs.sparkSession
    stored = spark.read.schema(keys).option("basePath", path).parquet(*(f"{path}/run={r}" for r in range(run))) if run else spark.createDataFrame([], keys)
    embedder(unseen(docs, stored, model, text)).select("key", "embedding").write.mode("overwrite").parquet(f"{path}/run={run}")


def embedded(spark, path: str) -> DataFrame:
    """(key, embedding, run) of everything at path."""
    return spark.read.schema("key string, embedding array<double>, run int").option("basePath", path).parquet(path)
