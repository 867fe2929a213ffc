"""Queries of sources, sinks, clearance and plug points: what takes a file, a path, a caller's function or a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as L
from ..operators import drivers as D
from ..operators import kpi as K
from ..operators import text as X
from ..sources import tables as T
from ..streaming import events as S
from .analytics import _seg_sql, segments
from .retrieval import RETRIEVERS, asked
from .sql import Registry
from .text import _BM25, bm25

query = Registry()

# A: a typed CSV file, and Parquet by month, each written from a given table and read back
_CSV = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("a1_csv_scan", f"SELECT {', '.join(_CSV)} FROM orders")
def _csv(c):
    rows, path = c.raw("orders").select(*_CSV), T.scratch(c.spark)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return T.read_csv(c.spark, path, rows.schema, multiline=False)


@query("a3_parquet_sink", "SELECT event_id, user_id, strftime(ts, '%Y-%m') AS month FROM events")
def _sink(c):
    path = T.scratch(c.spark)
    T.write_parquet(c.raw("events").select("event_id", "user_id", "ts"), path, "ts")
    return c.spark.read.parquet(path).select("event_id", "user_id", F.col("month").cast("string").alias("month"))


# E, H: what a clearance lets through
@query("e18_open_dimensions", "SELECT 'customer_state' AS dimension, count(DISTINCT customer_state) AS n FROM kpi_items WHERE in_analytical_window UNION ALL SELECT 'product_category', count(DISTINCT product_category) FROM kpi_items WHERE in_analytical_window")
def _open(c):
    """Of the dimensions that are asked for, those that the gate doesn't refuse."""
    kpi, out = K.Kpi(c, clearance="PUBLIC_ANALYTICAL"), None
    for dim in ("customer_state", "product_category", "seller_state"):
        try:
            part = kpi.compute("revenue", [dim]).agg(F.count(dim).alias("n")).select(F.lit(dim).alias("dimension"), "n")
        except PermissionError:
            continue
        out = part if out is None else out.unionByName(part)
    return out


@query("h13_allowed_segments", f"WITH {_seg_sql()} SELECT segment_type, segment_value, absolute_change FROM seg WHERE segment_type <> 'seller_state'")
def _allowed(c):
    kinds, _ = D.allowed_segments(None, "PUBLIC_ANALYTICAL")
    return segments(c).where(F.col("segment_type").isin(*kinds)).select("segment_type", "segment_value", "absolute_change")


# I, N: a scorer of pairs, a provider of vectors, a retriever, a runner of cases
def shared_words():
    """A scorer: the distinct words, between blanks, that a query and a text share."""
    return lambda pairs: [len(set(q.split(" ")) & set((t or "").split(" "))) for q, t in pairs]


@query("i25_rerank", f"""WITH {_BM25}, s AS (SELECT bm.query_id, bm.doc_id, len(list_intersect(string_split(q.text, ' '), string_split(d.text, ' ')))::DOUBLE AS score
    FROM bm JOIN benchmark q ON item_id = bm.query_id JOIN documents d USING (doc_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def _rerank(c):
    texts = c.raw("documents").select("doc_id", "text")
    pairs = bm25(c).select("query_id", "doc_id").join(texts, "doc_id").join(asked(c).withColumnRenamed("text", "query"), "query_id")
    return X.rerank(pairs, shared_words, 5)


def form():
    """A provider: a text's characters, lines and letters e."""
    return lambda texts: [[float(len(t)), float(t.count("\n") + 1), float(t.count("e"))] for t in texts]


@query("n1_embeddings", """SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::DOUBLE AS lines,
    (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS es FROM documents""")
def _embed(c):
    e = F.col("embedding")
    return X.embed(c.raw("documents").select("doc_id", "text"), form, "doc_id").select(
        "doc_id",
        e[0].alias("chars"),
        e[1].alias("lines"),
        e[2].alias("es"),
    )


def newest(c, k: int):
    """A retriever: the documents with the largest ids, the same for every query."""
    last = c.raw("documents").select("doc_id").orderBy(F.desc("doc_id")).limit(k)
    ends = last.agg(F.max("doc_id").alias("m"))
    ranked = last.crossJoin(F.broadcast(ends)).select(
        "doc_id",
        F.col("doc_id").cast("double").alias("score"),
        (F.col("m") - F.col("doc_id") + 1).cast("int").alias("rank"),
    )
    return asked(c).select("query_id").crossJoin(F.broadcast(ranked))


@query("n2_retriever", f"""WITH {_BM25}, n AS (SELECT item_id AS query_id, doc_id, ((SELECT max(doc_id) FROM documents) - doc_id + 1)::INTEGER AS rank FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 3))
    SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm WHERE rank <= 3 UNION ALL SELECT 'newest', query_id, doc_id, rank FROM n""")
def _retriever(c):
    """One of the library's retrievers and one of a caller's, by the same call."""
    known = {"bm25": RETRIEVERS["bm25"], "newest": newest}
    parts = [f(c, 3).select(F.lit(n).alias("method"), "query_id", "doc_id", "rank") for n, f in known.items()]
    return parts[0].unionByName(parts[1])


def double():
    """A runner of cases."""
    return lambda case: {"case_id": case["case_id"], "answer": 2 * case["n"], "long": len(case["name"])}


@query("n3_candidate_runner", "SELECT c_custkey AS case_id, 2 * c_nationkey AS answer, length(c_name) AS long FROM customer")
def _runner(c):
    cases = c.raw("customer").selectExpr("c_custkey AS case_id", "CAST(c_nationkey AS long) AS n", "c_name AS name")
    return L.run_candidates(cases, double, "case_id long, answer long, long long")


# L, M: an append-only log, and its state by way of a stream
@query("l16_appended_log", "SELECT event_id, user_id, event_type FROM events")
def _append(c):
    path, rows = T.scratch(c.spark), c.raw("events").select("event_id", "user_id", "event_type")
    for kind in (F.col("event_type") == "purchase", F.col("event_type") != "purchase"):
        L.append(rows.where(kind), path)
    return c.spark.read.parquet(path)


_FOLD = """SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS first_event, last(event_id ORDER BY ts, event_id) AS last_event,
    last(value ORDER BY ts, event_id) FILTER (value IS NOT NULL) AS value, count(*) AS events FROM events GROUP BY 1, 2"""


def _schema(df):
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


@query("m1_status_stream", _FOLD)
def _stream(c):
    """The log comes in two parts; the stream is stopped between them and goes on from its checkpoint."""
    log, out, checkpoint = (T.scratch(c.spark) for _ in range(3))
    given = c.raw("events")
    for kind in ("event_id % 2 = 0", "event_id % 2 = 1"):
        L.append(given.where(kind), log)
        state = S.fold(S.read_events(c.spark, log, _schema(given)))
        S.run_updates(state, out, checkpoint)
    return S.current(c.spark, out, _schema(state), ["user_id", "event_type"])


#: Arrival of an event: most come in their week, every 50th four weeks later, every 51st a day later.
_ARRIVES = "CASE WHEN event_id % 50 = 0 THEN 28 WHEN event_id % 51 = 0 THEN 1 ELSE 0 END"
#: Days after the first event at which a batch arrives; the last one takes all the rest.
_ARRIVALS = (7, 14, 21)
_SLOT = " + ".join(f"({{arrived}} >= {d})::INTEGER" for d in _ARRIVALS)
_LATE = """WITH a AS (SELECT event_type, ts, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + {arrives} AS arrived FROM events WHERE ts IS NOT NULL),
    b AS (SELECT event_type, ts, {slot} AS slot FROM a),
    m AS (SELECT slot, max(max(ts)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM b GROUP BY 1),
    w AS (SELECT event_type, slot, unnest([{{'g': 'day', 's': date_trunc('day', ts)::TIMESTAMP, 'e': date_trunc('day', ts) + INTERVAL 1 DAY}}, {{'g': 'week', 's': date_trunc('week', ts)::TIMESTAMP, 'e': date_trunc('week', ts) + INTERVAL 7 DAY}},
      {{'g': 'month', 's': date_trunc('month', ts)::TIMESTAMP, 'e': date_trunc('month', ts) + INTERVAL 1 MONTH}}]) AS w FROM b)
    SELECT w.g AS grain, strftime(w.s, '%Y-%m-%d') AS start, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late
    FROM (SELECT w, event_type, coalesce(w.e <= date_trunc('millisecond', mark), false) AS late FROM w JOIN m USING (slot)) GROUP BY ALL""".format(arrives=_ARRIVES, slot=_SLOT.format(arrived="arrived"))


@query("m2_window_stream", _LATE)
def _windows(c):
    """Days, weeks and months of an event stream that arrives in batches, some rows after the watermark has passed them."""
    log, out, checkpoint = (T.scratch(c.spark) for _ in range(3))
    given = c.raw("events")
    first = given.agg(F.to_date(F.min("ts")).alias("first"))
    arrived = F.datediff(F.to_date("ts"), "first") + F.expr(_ARRIVES)
    slotted = given.where("ts IS NOT NULL").crossJoin(F.broadcast(first)).withColumn("slot", sum((arrived >= d).cast("int") for d in _ARRIVALS))
    for slot in range(len(_ARRIVALS) + 1):
        L.append(slotted.where(F.col("slot") == slot).select(*given.columns), log)
        counts = S.window_counts(S.read_events(c.spark, log, _schema(given)))
        S.run_updates(counts, out, checkpoint)
    return S.current(c.spark, out, _schema(counts), ["grain", "start", "event_type"])
