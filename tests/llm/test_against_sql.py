"""Queries that SQL can express, against DuckDB; and small fixtures with the awkward cases."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricwell.llm import line_chunks, registry, threshold_topk
from metricwell.llm.exact_dedup import _retain, _runs, exact_dedup, merge_runs
from metricwell.llm.line_chunks import dedup_lines, without_repeats
from metricwell.llm.mixing import mix
from metricwell.llm.quotes import link_quotes
from metricwell.llm.threshold_topk import top_k


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, duck, data, same):
    same(registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


def test_exact_dedup_cases(spark):
    rows = [(1, "a b", 0), (2, "a  b", 0), (3, "ab", 0), (4, None, 0), (5, " ", 0), (None, "ab", 0), (6, "x" * 200_000, 0), (6, "x" * 200_000, 0)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, kept int")).toPandas()
    by = {(r.doc_id, r.keep_id): (r.group_size, r.kept) for r in got[got.doc_id.notna()].itertuples()}
    assert by[(2, 2)] == (4, True) and by[(1, 2)] == (4, False) and by[(3, 2)] == (4, False)
    assert by[(5, 5)] == (2, True) and by[(4, 5)] == (2, False) and by[(6, 6)] == (2, True)
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup_keeps_large_ids_beside_null_ones(spark):
    rows = [(9007199254740993, "t u"), (9007199254740995, "tu"), (None, "t  u"), (None, "other"), (9007199254740997, "x")] * 2
    for parts in (1, 3):
        got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got}
        assert by[9007199254740993] == by[9007199254740995] == (None, 6, False) and by[9007199254740997] == (9007199254740997, 2, True)
        assert len(got) == len(rows) and sum(r.kept for r in got) == 6 and {(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None} == {(None, 6, True), (None, 2, True)}


@pytest.mark.parametrize(("partitions", "steps"), [(1, 3), (5, 1), (16, 2), (64, 3)])
def test_every_level_of_the_tree_keeps_the_smallest(spark, partitions, steps):
    rows = [(i, f"text {i % 37 if i % 3 else 0}" + " " * (i % 2)) for i in range(900)]
    runs = _runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    got = {(r.doc_id, -r.less, r.n) for r in merge_runs(runs, partitions, steps).collect()}
    want = {}
    for i, t in rows:
        want.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    assert got == {(min(v)[1], -min(v)[0], len(v)) for v in want.values()}


def test_runs_go_on_over_batches():
    names, rows = ["digest", "proof", "bytes", "doc_id", "n"], [(b"a" * 32, 1, 1, i, 1) for i in range(5)] + [
        (b"a" * 32, 2, 1, 5, 1),
        (b"b" * 32, 1, 1, 6, 3),
        (b"b" * 32, 1, 1, 7, 4),
    ]
    schema = pa.schema([pa.field(x, pa.binary() if x == "digest" else pa.int64(), nullable=x == "doc_id") for x in names])
    for size in (1, 2, 3, 8):
        batches = [
            pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]], schema=schema) for i in range(0, 8, size)
        ]
        got = [tuple(r.values()) for b in _retain(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert [(r[1], r[3], r[4]) for r in got] == [(1, 0, 5), (2, 5, 1), (1, 6, 7)]


def test_top_k_cases(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [0.5, 0.5]),
        (2, [0.5, -0.5]),
        (3, None),
        (4, [float("nan"), 1.0]),
        (5, [None, 1.0]),
        (20, [0.0, 0.0]),
        (None, [1.0, 1.0]),
        (6, [0.5, 9.0]),
    ]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 2, 6]
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == [0, 1, 2]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_rows_of_one_id_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1e300, -1e300]), (3, [1e18, 1e18]), (4, [-1e300, 3.0]), (20, [1e300, 1e18])]
    got = top_k(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), k=4, block=3).collect()
    high, low = 2**63 - 1, -(2**63)
    whole = [(i, [max(low, min(high, math.floor(64 * x))) for x in v]) for i, v in rows]
    want = []
    for n, (i, q) in enumerate(whole):
        if i % 20 == 0:
            found = sorted((-max(low, min(high, sum(a * b for a, b in zip(q, v, strict=True)))), j) for m, (j, v) in enumerate(whole) if m != n)[:4]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_over_many_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(threshold_topk, "QUERIES", 7)
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in draw.integers(-2, 3, 3) / 64]) for i in range(300)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=10, block=40).collect()
    e = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    want = {(q, r + 1, j, -s) for q in range(0, 300, 10) for r, (s, j) in enumerate(sorted((-int(e[q] @ e[j]), j) for j in e if j != q)[:5])}
    assert {tuple(r) for r in got} == want


def test_the_bound_leaves_vectors_out():
    draw = np.random.default_rng(2)
    rows = np.floor(64 * draw.normal(size=(4000, 16)) * 0.4 ** np.arange(16)).astype(np.int64)  # a few strong dimensions
    lists = np.argsort(rows.T, axis=1, kind="stable")
    for q in range(5):
        score = rows @ rows[q]
        want = [i for i in np.lexsort((np.arange(4000), -score)) if i != q][:10]
        best, found, seen = threshold_topk.threshold_top_k(rows[q], q, rows, lists, 10)
        assert best.tolist() == want and found.tolist() == score[want].tolist() and seen < 3000
        again = threshold_topk.threshold_top_k(rows[q], q, rows, lists, 10, int(score[want[0]]))
        assert again[2] <= seen and again[0][0] == want[0]  # a higher k-th score from elsewhere stops it sooner


def test_line_dedup_cases(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(40))
    rows = [
        (1, f"own\n{passage}\nend", "a"),
        (2, f"other start\nmore\n{passage}", "b"),
        (3, None, "c"),
        (4, "", "d"),
        (5, "one line", "e"),
        (6, "one line", "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[1].removed_lines == got[1].removed_chunks == 0 and got[2].removed_lines == 40 and got[2].removed_chunks > 5 and got[2].text == "other start\nmore"
    assert got[3].text is None and got[4].text == "" and got[5].text == got[6].text == "one line"
    assert {r.row for r in without_repeats(docs.withColumnsRenamed({})).select("doc.row").collect()} == set("abcdef")
    assert dedup_lines(docs.limit(0)).count() == 0


def test_lines_with_equal_codes_and_other_bytes_stay(spark, monkeypatch):
    rows = [(1, "aa\nbb\nc1\nd"), (2, "xx\naa\nbb\nc2"), (3, "bb\nc1\nd\nd"), (4, "bb\nc2")]
    real = line_chunks._code
    monkeypatch.setattr(line_chunks, "_code", lambda c: F.when(c.cast("string").startswith("c"), real(F.lit("c"))).otherwise(real(c)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "xx\nc2", 3: rows[2][1], 4: rows[3][1]}


def test_mixing_cases(spark):
    rows = [
        (i, "w " * 10, "en" if i % 2 else None, f"s{i % 3}", "x") for i in range(200)
    ] + [(500, None, "en", "s0", "x"), (501, "", "en", "s0", "x")]
    docs = spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, _mix_key string",
    ).withColumn("_mix_tokens", F.lit(1)).withColumn("taken", F.lit("t"))
    got = mix(docs, share=0.5).select("doc.doc_id", "doc._mix_key", "doc._mix_tokens", F.col("doc.taken").alias("own"), "tokens", "taken").toPandas()
    assert 900 <= got.taken.sum() <= 1000 and not {500, 501} & set(got.doc_id) and set(got._mix_key) == {"x"} and set(got._mix_tokens) == {1} and set(got.own) == {"t"}
    assert (got.taken > 0).all() and (got.taken <= got.tokens).all()
    assert mix(docs.limit(0)).count() == 0


def test_quote_cases(spark):
    rows = [
        (1, 0, "u", "Hello there\nsecond"),
        (1, 1, "a", "> hello  there\n> second\nyes"),
        (1, 2, "u", ">> hello there\n>> second\n> yes\nok"),
        (1, 3, "u", "> nowhere\nlost"),
        (None, 1, "u", "> q"),
        (2, None, "u", "x"),
        (2, 0, "u", None),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1].reply_to, got[1, 1].text) == (0, "yes") and (got[1, 2].reply_to, got[1, 2].thread, got[1, 2].linked) == (1, 0, 2)
    assert got[1, 3].reply_to is None and got[1, 3].quotes == 1 and got[2, 0].text == ""


def made_conversations(seed):
    """Threads with quotations of whole messages, of runs and of single lines, nested, forked, changed and repeated."""
    draw, rows = random.Random(seed), []
    for conv in range(25):
        said = []
        for turn in range(draw.randint(1, 14)):
            lines = [f"line {draw.randint(0, 30)} of {conv % 3}" for _ in range(draw.randint(0, 3))]
            for _ in range(draw.randint(0, 2) if said else 0):
                source = said[max(0, len(said) - 1 - draw.choice([0, 0, 0, 1, 3]))]
                parts = source.split("\n")
                a = draw.randrange(len(parts))
                some = draw.choice([parts, parts[a : a + 1], parts[a:], [x.upper() + "  " for x in parts], ["never said", *parts]])
                mark = draw.choice(["> ", ">", " > "])
                lines[draw.randint(0, len(lines)) : 0] = [mark + x for x in some]
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, draw.choice(["user", "assistant"]), text))
    return [*rows, *rows[5:9], (None, 1, "user", "> line 1 of 0"), (3, None, "user", "> line 1 of 0\nown"), (4, 40, None, None), (5, 0, "user", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_of_made_threads_against_sql(spark, same, seed):
    rows = made_conversations(seed)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = link_quotes(
        spark.createDataFrame(
            rows,
            "conv_id long, turn long, role string, text string",
        ).withColumn("level", F.lit(9)).withColumn("thread", F.lit("x"))
    ).toPandas()
    same(got, con.sql(registry.ORACLE_SQL["op7_quotes"]).df())
    assert got.linked.sum() > 40 and (got.quotes > got.linked).any() and (got.thread < got.reply_to).any()
    for _, own in got.dropna(subset=["conv_id", "turn", "reply_to"]).groupby("conv_id"):
        assert (own.reply_to < own.turn).all() and (own.thread <= own.reply_to).all()


def test_quotes_of_an_empty_table(spark):
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_of_a_deep_thread(spark):
    rows = [(1, 0, "u", "start 0")] + [(1, t, "u", f"> start {t - 1}\nstart {t}") for t in range(1, 40)]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[t].reply_to == t - 1 and got[t].thread == 0 and got[t].text == f"start {t}" for t in range(1, 40))
