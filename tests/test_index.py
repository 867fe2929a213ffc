"""The stored index against plain BM25+, in one segment and in several, with and without candidates."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metricwell.operators import text as X
from metricwell.operators.index import TermIndex, among, bitmaps, terms_of
from metricwell.operators.skew import hot_keys, join_hot

WORDS = [f"w{i}" for i in range(40)] + ["ﬁne", "fine", "Ünder", "the"]


def plain(docs, queries, allowed=None):
    tok = lambda t: [w for w in (t or "").replace("ﬁ", "fi").lower().split() if w not in X.STOP_WORDS]
    bags = {i: tok(t) for i, t in docs}
    df, mean, out = Counter(w for b in bags.values() for w in set(b)), sum(map(len, bags.values())) / len(bags), {}
    for q, t in queries:
        for i, b in bags.items():
            tf, s, hit = Counter(b), 0.0, False
            for w in set(tok(t)):
                if tf[w] and (allowed is None or (q, i) in allowed):
                    hit = True
                    idf = math.log((len(bags) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    s += idf * (tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(b) / mean)) + 1)
            if hit:
                out[q, i] = round(s, 5)
    return out


@pytest.fixture(scope="module")
def given(spark):
    draw = random.Random(1)
    docs = [(i, " ".join(draw.choices(WORDS, k=draw.randint(0, 30)))) for i in range(-3, 120)] + [(500, None), (70_000, "w1 w2 fine")]
    queries = [(q, " ".join(draw.choices(WORDS, k=4))) for q in range(8)] + [(8, "nothing here"), (9, "w1 w1 FINE")]
    return docs, queries, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def scored(rows):
    return {(r.query_id, r.doc_id): round(r.score, 5) for r in rows.collect()}


def test_segments_score_like_one_index(spark, given):
    docs, queries, d, q = given
    want = plain(docs, queries)
    whole = TermIndex(spark, 3).add(d)
    parts = TermIndex(spark, 3).add(d.where("doc_id < 20")).add(d.where("doc_id BETWEEN 20 AND 60")).add(d.where("doc_id > 60"))
    for index in (whole, parts):
        assert scored(index.scores(terms_of(q))) == pytest.approx(want, abs=2e-5)
        assert index.stats().first()["documents"] == len(docs)
        bounds = {(r.query_id, r.term): r.bound for r in index.weighted(terms_of(q)).collect()}
        assert all(s <= sum(b for (x, _), b in bounds.items() if x == i) + 1e-6 for (i, _), s in want.items())
    ranked = [(r.rank, r.score, r.doc_id) for r in whole.top(terms_of(q), 5).where("query_id = 0").orderBy("rank").collect()]
    assert ranked == sorted(ranked, key=lambda r: (-r[1], r[2])) and len(ranked) == 5


def test_an_index_is_opened_again_and_skips_what_is_not_committed(spark, given):
    docs, queries, d, q = given
    index = TermIndex(spark, 3).add(d.where("doc_id < 20"), name="first").add(d.where("doc_id >= 20"), name="second")
    left = spark.table(index.table).limit(5).withColumn("segment", F.lit("cut_short"))  # postings without a commit
    left.write.mode("append").partitionBy("segment").bucketBy(3, "term", "shard").sortBy("term", "shard").option("path", f"{index.path}/postings").saveAsTable(index.table)
    spark.sql(f"DROP TABLE {index.table}")  # a session that has not written it
    again = TermIndex(spark, 7, index.path)
    assert again.buckets == 3 and set(again.segments) == {"first", "second"}
    before = again.segments
    assert again.add(d, name="second").segments == before  # there already: nothing is added
    assert scored(again.scores(terms_of(q))) == pytest.approx(plain(docs, queries), abs=2e-5)
    more = [(1000, "w1 w2 w3"), (1001, "Ünder w5")]
    again.add(spark.createDataFrame(more, "doc_id long, text string"), name="third")
    assert scored(again.scores(terms_of(q))) == pytest.approx(plain(docs + more, queries), abs=2e-5)


def test_two_writers_of_one_segment_count_once(spark, given):
    docs, queries, d, q = given
    one = TermIndex(spark, 2)
    other = TermIndex(spark, 2, one.path)  # opened before the first has committed
    one.add(d, name="all")
    other.add(d, name="all")
    for index in (other, TermIndex(spark, path=one.path)):
        assert scored(index.scores(terms_of(q))) == pytest.approx(plain(docs, queries), abs=2e-5)
        assert index.stats().first()["documents"] == len(docs)


def test_an_index_of_a_table_follows_its_files(spark, given, tmp_path):
    docs, queries, d, q = given
    path = f"file://{tmp_path}/docs"
    d.where("doc_id < 50").write.parquet(path)
    table = spark.read.parquet(path)
    first = TermIndex.of_table(table).add(table, name="all")
    assert TermIndex.of_table(spark.read.parquet(path)).segments == first.segments
    d.where("doc_id >= 50").write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    assert TermIndex.of_table(table).segments == {}
    assert scored(TermIndex.of_table(table).add(table, name="all").scores(terms_of(q))) == pytest.approx(plain(docs, queries), abs=2e-5)


def test_candidates_are_kept_apart_by_query(spark, given):
    docs, queries, d, q = given
    draw = random.Random(2)
    allowed = {(i, j) for i, _ in queries for j, _ in docs if i != 3 and draw.random() < 0.4}
    pairs = spark.createDataFrame(sorted(allowed), "query_id long, doc_id long")
    index = TermIndex(spark, 2).add(d)
    assert scored(index.scores(terms_of(q), pairs)) == pytest.approx(plain(docs, queries, allowed), abs=2e-5)
    every = spark.createDataFrame([(i, j) for i, _ in queries for j, _ in docs], "query_id long, doc_id long")
    assert {tuple(r) for r in among(every, bitmaps(pairs)).collect()} == allowed


def test_postings_are_not_shuffled_by_a_search(spark, given):
    index = TermIndex(spark, 4).add(given[2])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.hits(terms_of(given[3]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "postings" in line)
    assert "Bucketed: true" in scan
    before = plan.splitlines()[: plan.splitlines().index(scan)]
    assert not any("Exchange" in line for line in before[before.index(next(x for x in before if "SortMergeJoin" in x)) :])


def test_cosine_among_candidates(spark):
    rows = [(i, [math.cos(i), math.sin(i), i % 3 - 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asking = v.where("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    every = asking.select("query_id").crossJoin(v.select("vec_id"))
    few = every.where("vec_id % 5 = query_id % 5 OR vec_id = 40")
    want = {(r.query_id, r.vec_id): r.score for r in X.cosine_top_k(v, asking, 100).collect()}
    got = {(r.query_id, r.vec_id): r.score for r in X.cosine_among(few, v, asking, 100).collect()}
    assert got == pytest.approx({k: want[k] for k in got}, abs=2e-6) and set(got) == {(r.query_id, r.vec_id) for r in few.where("vec_id <> 41").collect()}


def test_joins_on_hot_keys(spark):
    rows = [(0 if i % 3 else i, i) for i in range(3000)] + [(None, -1)]
    many, one = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame([(i, f"n{i}") for i in range(0, 3000, 2)], "k long, name string")
    assert [r.k for r in hot_keys(many, ["k"]).collect()] == [0]
    for how, test in (("inner", lambda k: k is not None and k % 2 == 0), ("left_semi", lambda k: k is not None and k % 2 == 0), ("left_anti", lambda k: k is None or k % 2)):
        assert sorted(r.v for r in join_hot(many, one, ["k"], how).collect()) == sorted(v for k, v in rows if test(k))
