"""Operators without SQL: brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricwell.llm.bagminhash import multisets, near_duplicates, op9_bagminhash, signatures, similar_classes, spanning_links
from metricwell.llm.language_id import KernelClassifier, identify_languages, keep_identified, op4_language_id
from metricwell.llm.packing import SEQUENCE, WordTokenizer, best_fit, crossover, default_tokenizer, evolve, op10_packing, pack, refill
from metricwell.llm.quality import FEATURES, AttentionModel, op1_quality, score_quality

EDGE = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the cat sat on the mat " * 3000), (None, "ein Text"), (5, "ein Text"), (5, "ein Text")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in EDGE], "doc_id long, text string, lang string, source string, score double")


def bags(texts):
    out = []
    for t in texts:
        w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())
        out.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    return out


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_estimate_weighted_jaccard():
    texts = ["a b c d e f g h i j " * 3 + "k l m n o p", "a b c d e f g h i j " * 2 + "k l m n o q r s"]
    gram, count, doc, _ = multisets(texts)
    regs = signatures(gram, count, doc, 2, size=4096)
    assert abs((regs[0] == regs[1]).mean() - similarity(*bags(texts))) < 0.03


def test_near_duplicates_brute_force(spark, data):
    got = op9_bagminhash(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    sets, root = bags(docs.text), {i: i for i in docs.doc_id}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(zip(docs.doc_id, sets, strict=True), 2):
        if s and t and similarity(s, t) >= 0.8 - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {i: find(i) for i in root} == dict(zip(got.doc_id, got.class_id, strict=True))


def test_hot_buckets_lose_no_link(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:50] + [f"x{k}"] + base[50:])) for k in range(60)]
    rows += [(100 + k, " ".join(base[: 60 - k] + [f"y{k}_{j}" for j in range(k)])) for k in range(1, 40)]  # a chain away from it
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = bags([t for _, t in rows]), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(zip(root, sets, strict=True), 2):
        if similarity(s, t) >= 0.8 - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: find(i) for i in root}
    assert 3 < len(set(want.values())) < 90
    for block in (8, 512):
        assert {r.doc_id: r.class_id for r in near_duplicates(docs, block=block).collect()} == want


def test_verified_links_connect_all_that_share_a_bucket(spark):
    draw, sets = random.Random(5), []
    for g in range(6):  # overlapping runs: neighbours are similar, others are not
        sets += [np.arange(1000 * g + 9 * i, 1000 * g + 9 * i + 100, dtype=np.uint64) for i in range(12)]
    names = [bytes([i]) * 16 for i in range(len(sets))]
    buckets = [(7, 0, n, 100) for n in names] + [(100 + b, b, n, 100) for b in range(1, 5) for n in draw.sample(names, 30)]
    b = spark.createDataFrame(buckets, "band long, number int, digest binary, size long")
    i = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(names, sets, strict=True)], "digest binary, items binary")
    for block in (5, 500):
        roots = {bytes(r.node): bytes(r.root) for r in similar_classes(b, i, block).collect()}
        assert [roots[n] for n in names] == [names[k - k % 12] for k in range(len(names))]


def test_buckets_are_joined_once_a_round_and_never_for_blocks_that_are_not_there(spark, monkeypatch):
    from metricwell.llm import bagminhash

    met, joined, held = [], bagminhash.join_keyed, bagminhash.materialize
    written = []
    monkeypatch.setattr(bagminhash, "join_keyed", lambda many, one, keys, *rest: met.append(joined(many, one, keys, *rest)) or met[-1])
    monkeypatch.setattr(bagminhash, "materialize", lambda df: written.append(df) or held(df))
    names = [bytes([i]) * 16 for i in range(40)]
    b = spark.createDataFrame([(n % 2, n % 2, d, 100) for n, d in enumerate(names)], "band long, number int, digest binary, size long")
    i = spark.createDataFrame([(d, np.arange(1000 * n, 1000 * n + 100, dtype=np.uint64).tobytes()) for n, d in enumerate(names)], "digest binary, items binary")
    assert similar_classes(b, i).isEmpty()
    assert len(met) == 2 and all(any(m is w for w in written) for m in met)  # the two rounds, each written; no third one
    alone = spark.createDataFrame([(n, 0, d, 100) for n, d in enumerate(names)], "band long, number int, digest binary, size long")
    assert similar_classes(alone, i).isEmpty() and len(met) == 2


def test_spanning_links_connect_chains():
    items = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 8, 16, 24, 500)]
    links = spanning_links(items)
    assert len(links) == 3 and 4 not in {x for p in links for x in p}
    assert spanning_links(items, ["p", "p", "q", "q", "q"]) in ([(1, 2)], [(2, 1)], [(0, 2)], [(2, 0)]) and spanning_links(items[:4], ["p"] * 4) == []


def test_near_duplicate_edges(edge):
    got = near_duplicates(edge).toPandas()
    assert len(got) == 7 and got[got.doc_id == 5].class_id.tolist() == [5, 5] and got[got.doc_id == 1].class_id.item() == got[got.doc_id == 2].class_id.item() == 1
    assert near_duplicates(edge.limit(0)).count() == 0


def test_language_held_out(spark, data, edge):
    got = op4_language_id(spark, data).toPandas()
    lang = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(lang, on="doc_id")[lambda d: d.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert (held.lang == held.lang_pred).mean() > 0.95
    shown = identify_languages(edge).toPandas()
    assert shown[shown.doc_id.isin([1, 2, 3])].lang_pred.tolist() == ["und"] * 3 and len(shown) == 7
    assert identify_languages(edge.limit(0)).count() == 0


def test_quality_held_out(spark, data, edge):
    got = op1_quality(spark, data).toPandas()
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id")[lambda d: d.held_out]
    assert (held.quality == held.predicted).mean() > 0.8 and got.score.between(0, 1).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert set(score_quality(edge, none).toPandas().score) == {0.5}


def test_attention_by_plain_loops_and_gradient_by_differences():
    draw = np.random.default_rng(0)
    x, first, label = draw.normal(size=(9, FEATURES)), np.array([0, 2, 3, 7, 9]), np.array([1.0, 0, 1, 0])
    model = AttentionModel(seed=3, width=4, gate=3)
    p = model.p

    def plain(x):
        out = []
        for a, b in zip(first, first[1:], strict=False):
            h = [np.tanh(v @ p["E"] + p["e"]) for v in x[a:b]]
            s = np.exp([p["w"] @ (np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) for v in h])
            z = sum(w * v for w, v in zip(s / s.sum(), h, strict=True))
            out.append(1 / (1 + np.exp(-(z @ p["c"] + p["b"][0]))))
        return np.array(out)

    assert np.allclose(model.forward(x, first)["y"], plain(x))
    loss = lambda: -np.mean(label * np.log(plain(x)) + (1 - label) * np.log(1 - plain(x)))
    grad = model.gradient(x, first, label, np.full(4, 0.25))
    for name, i in [("E", (3, 1)), ("e", (2,)), ("V", (1, 2)), ("U", (0, 1)), ("w", (2,)), ("c", (3,)), ("b", (0,))]:
        p[name][i] += 1e-5
        up = loss()
        p[name][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grad[name][i]) < 1e-6
        p[name][i] += 1e-5


def test_quality_awkward_tables(spark, edge):
    words = lambda i: " ".join(f"w{(i * k) % 97}" for k in range(40)) if i % 2 else "!! ?? " * 30
    rows = [(i, words(i)) for i in range(120)] + [(1, words(1)), (None, "x"), (7, "y " * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame(
        [(i, i % 2, 5) for i in range(120)] + [(3, None, 5), (None, 1, 5), (4, 9, 5)],
        "doc_id int, quality long, score int",
    )
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and np.mean([r.predicted == r.doc_id % 2 for r in got[:120] if r.held_out]) > 0.9
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and score_quality(edge.limit(0), labels).count() == 0


def test_tokens_are_those_of_the_tokenizer():
    t = WordTokenizer(default_tokenizer())
    for text in ("Hello, WORLD's café—naïve 1234!! x y", "a\x1cb <|endoftext|> c", "", "ΑΣ Σ İstanbul é", "don't... ​zero"):
        assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == t.model.encode(text, add_special_tokens=False).ids


def plain_pieces(texts):
    """(row, piece, start, length, crc) of every piece, by the tokenizer itself, one text at a time."""
    model = WordTokenizer(default_tokenizer()).model
    for i, text in enumerate(texts):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), SEQUENCE):
            own = ids[k : k + SEQUENCE]
            yield i, k // SEQUENCE, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())


def check_packing(got, rows):
    """Every piece of every row once, sequences without gap or overflow."""
    want = Counter((rows[i][0], *rest) for i, *rest in plain_pieces([t for _, t in rows]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    return len(bins), -(-sum(r.length for r in got) // SEQUENCE)


def test_packing_against_the_tokenizer(spark, data, edge):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    used, least = check_packing(op10_packing(spark, data).collect(), rows)
    assert used <= least + 1
    check_packing(pack(edge).collect(), EDGE)
    assert pack(edge.limit(0)).count() == 0


def test_a_word_is_looked_up_once_for_all_texts():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return dict.get(self, *key)

    tokenizer = WordTokenizer(default_tokenizer())
    tokenizer.known = Counted(tokenizer.known)
    texts = ["the cat sat on the mat, " * 40, " The\tcat\u2003sat\u00a0on\x85it\n\n", "", "  ", "<|endoftext|> cat", "a\x1ccat", "\u0130 \u03a3\u03a3 \u4e2d\u6587 cat"]
    got = tokenizer.encode(texts)
    want = [np.array(tokenizer.model.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert got == want and 0 < Counted.asked < 40


def test_a_word_is_encoded_once_whatever_signs_stand_beside_it():
    tokenizer = WordTokenizer(default_tokenizer())
    texts = ["cat, cat. (cat) Cat! cat&&& \"cat\"; cat_cat", "caf\u00e9, \u00e9tude: caf\u00e9*** cat/caf\u00e9", "cat\u2014 CAT? CAF\u00c9!!"]
    got = tokenizer.encode(texts)
    assert got == [np.array(tokenizer.model.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    letters = {w for w in tokenizer.known if any(c.isalpha() for c in w)}
    assert letters == {"cat", "caf\u00e9", "\u00e9tude", "cat\u2014", "CAT", "CAF\u00c9"}


def test_signs_beside_letters_are_cut_off_only_where_the_tokenizer_cuts():
    draw, tokenizer = random.Random(8), WordTokenizer(default_tokenizer())
    some = [*"abestrzABST019 '\"_.,;:!<>|&$`=-/()[]{}@#\n\t\x00\x1c\x7f", *map(chr, (0x80, 0x85, 0xA0, 0xAA, 0xB2, 0xC0, 0xD7, 0xDF, 0xE9, 0xF7, 0xFF))]
    some += map(chr, (0x130, 0x131, 0x149, 0x151, 0x17F, 0x180, 0x1C5, 0x2B0, 0x300, 0x307, 0x338, 0x3A3, 0x2019, 0x2014, 0x200B, 0x3000, 0x4E2D, 0x1100, 0x1161, 0x1F600))
    some += ["'s", "'ll", "''s", "\"'t", "d'", "<|endoftext|>"]
    texts = ["", "it's ''s \"'s x's' o'\u00e9", "\u0130, ,\u0130 \u00d7, \u00e9,\u00e9 a\u0301,a\u0301 a<\u0338b", "'", "a", ",", "\u00e9"]
    texts += ["".join(draw.choices(some, k=draw.randrange(40))) for _ in range(3000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.model.encode_batch_fast(texts, add_special_tokens=False)]
    assert tokenizer.encode(texts) == want and [tokenizer.encode([x])[0] for x in texts[:200]] == want[:200]


def test_packing_on_islands_and_large_ids_beside_null(spark):
    rows = [(2**53 + k if k % 9 else None, "the cat sat on a mat " * (1 + k * 7 % 260)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used, least = check_packing(pack(docs, island=80).collect(), rows)
    assert used <= least + 4


def hard_lengths(times):
    """Triples and quadruples that fill a sequence, of which greedy filling makes pairs that nothing fits beside."""
    return [1044] * (6 * times) + [552] * (6 * times) + [532] * (6 * times) + [472] * (12 * times)


def test_genetic_steps_better_greedy_filling():
    lengths = hard_lengths(10)
    assert len(best_fit(Counter(lengths))) == 110 and len(evolve(lengths, 1)) == 90 == sum(lengths) // SEQUENCE
    draw = random.Random(4)
    lengths = [draw.randint(500, 1000) for _ in range(600)]
    assert len(evolve(lengths, 2)) < 0.98 * len(best_fit(Counter(lengths)))


def test_a_kept_bin_takes_a_displaced_piece():
    child = crossover([[6], [5, 4], [3, 2]], [[5, 3, 2]], Counter([6, 5, 4, 3, 2]), random.Random(1), 10)
    assert sorted(map(sorted, child)) == [[2, 3, 5], [4, 6]]
    assert sorted(map(sorted, refill([[7], [4], [5, 5]], Counter([3, 5, 2, 8]), 10))) == [[2, 8], [3, 7], [4, 5], [5, 5]]


def test_a_child_is_no_worse_than_its_better_parent():
    for seed in range(12):
        draw = random.Random(seed)
        stock = Counter(draw.randint(200, 1500) for _ in range(400))
        parents = []
        for _ in range(2):
            bins, left = [], stock.copy()
            for n in draw.sample(sorted(stock.elements()), k=150):
                fits = [m for m in left if left[m] and m <= SEQUENCE - n and (m != n or left[m] > 1)]
                if left[n] and fits:
                    m = draw.choice(fits)
                    left.subtract([n, m])
                    bins.append([n, m])
            parents.append(bins + best_fit(+left))
        child = crossover(*parents, stock, draw)
        assert len(child) <= min(map(len, parents)) and Counter(n for b in child for n in b) == stock


def test_migrants_better_an_island():
    lengths = hard_lengths(4)
    poor, good = best_fit(Counter(lengths)), evolve(lengths, 1)
    stock = Counter(lengths)
    child = crossover(poor, [b for b in good if sum(b) == SEQUENCE], stock, random.Random(1))
    assert len(child) < len(poor) and Counter(n for b in child for n in b) == stock
    assert len(evolve(lengths, 3, poor, [b for b in good if sum(b) == SEQUENCE])) <= len(good)


def test_genetic_steps_keep_all_pieces():
    draw = random.Random(3)
    lengths = [draw.randint(1, 2047) for _ in range(500)]
    stock = Counter(lengths)
    first = best_fit(stock)
    for bins in (first, crossover(first, first[::-1], stock, random.Random(1)), evolve(lengths, 1), evolve(lengths, 2, first, first[:20]), evolve([], 1)):
        assert Counter(n for b in bins for n in b) == (stock if bins else Counter()) and max(map(sum, bins), default=0) <= SEQUENCE


def test_pipeline_stages(spark, data, same):
    """Order, rows of mixing against its SQL and pieces of packing against the tokenizer, each on its own input."""
    import duckdb

    from metricwell.llm.mixing import OP5_SQL

    docs, kept, before = spark.read.parquet(f"{data}/documents.parquet"), [], None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, corpus_pipeline.materialize(stage(spark, docs, data))
        kept.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == columns
        if name == "mixing":
            con = duckdb.connect()
            con.register("documents", given.toPandas())
            want = con.sql(OP5_SQL).df().groupby("doc_id").size().rename("n").reset_index()
            same(docs.toPandas().groupby("doc_id").size().rename("n").reset_index(), want)
            texts = {r.doc_id: r for r in given.collect()}
            assert all(tuple(r) == tuple(texts[r.doc_id]) for r in docs.collect())
        if name == "packing":
            used, least = check_packing(docs.collect(), [(r.doc_id, r.text) for r in given.collect()])
            assert used <= least + 1
    assert [n for n, _ in kept] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"] and kept[0][1] >= kept[1][1] >= kept[2][1] > 0


def test_language_kernel_by_sets():
    texts = [
        "the cat and the dog",
        "der hund und die katze",
        "le chat et le chien",
        "el perro y el gato",
        "a b c",
        "die katze und der hund schlafen",
        "the dog sleeps",
        "le chien dort",
        "el gato duerme",
    ]
    labels = ["en", "de", "fr", "es", "en", "de", "en", "fr", "es"]
    model = KernelClassifier.fit(texts, labels, landmarks=9, ridge=1e-2)

    def grams(t):
        code = " ".join(t.lower().split())
        return {code[i : i + n] for n in (1, 2, 3) for i in range(len(code) - n + 1)}

    kernel = lambda a, b: len(grams(a) & grams(b)) / max(len(grams(a)) * len(grams(b)), 1) ** 0.5
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    value, vector = np.linalg.eigh(k)
    good = value > 1e-9 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    x = np.hstack((k @ root, np.ones((9, 1))))
    y = np.where(np.array(labels)[:, None] == np.array(sorted(set(labels)))[None, :], 1.0, -1.0)
    share = np.array([1 / labels.count(c) for c in labels])
    w = np.linalg.solve(x.T @ (x * share[:, None]) + 1e-2 * np.eye(x.shape[1]), x.T @ (y * share[:, None]))
    new = ["the cat sleeps", "und der hund", "", "xyz ö", "le gato"]
    want = np.hstack((np.array([[kernel(a, b) for b in texts] for a in new]) @ root, np.ones((5, 1)))) @ w
    assert np.allclose(model.margins(new), want, atol=1e-4)


@pytest.mark.parametrize(("languages", "letters", "words"), [(100, 30, 20), (70, 60, 20), (40, 30, 6)])
def test_many_scripts_are_told_apart(languages, letters, words):
    draw, texts, labels = random.Random(languages), {0: [], 1: []}, {0: [], 1: []}
    for n in range(languages):
        script = [chr(0x3400 + 64 * n + k) for k in range(letters)]
        for i in range(24):
            texts[i % 2].append(" ".join("".join(draw.choices(script, k=5)) for _ in range(words)))
            labels[i % 2].append(f"l{n:03d}")
    model = KernelClassifier.fit(texts[0], labels[0])
    got = [model.languages[b] for b in model.margins(texts[1]).argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(got, labels[1], strict=True)]) >= 0.95


def test_keep_identified_drops_texts_of_no_language(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    junk = [(90_000 + i, t, None) for i, t in enumerate(["привет мир как дела сегодня утром", "xqzj kkwv zzqx wvkq jjxz qqkw zvxj"])]
    got = {r.doc_id for r in keep_identified(docs.unionByName(spark.createDataFrame(junk, docs.schema))).collect()}
    assert not [i for i in got if i >= 90_000] and len(got) >= 0.99 * docs.count()


def test_keep_identified_judges_short_texts(spark):
    """Fewer than 32 distinct n-grams are judged by what excerpts of that size reach."""
    draw, rows = random.Random(6), []
    for i in range(300):
        letters = "abcdefghijklm" if i % 2 else "αβγδεζηθικλμν"
        rows.append((i, " ".join("".join(draw.choices(letters, k=4)) for _ in range(draw.choice((2, 3, 40)))), "ab"[i % 2]))
    foreign = [(1000, "привет мир", None), (1001, "приветик", None), (1002, "opqr stuv", None), (1003, "abcd efgh", None), (1004, "αβγδ", None)]
    got = {r.doc_id for r in keep_identified(spark.createDataFrame(rows + foreign, "doc_id long, text string, lang string")).collect()}
    assert not got & {1000, 1001, 1002} and {1003, 1004} <= got and len(got) >= 297


def test_keep_identified_on_awkward_rows(spark, edge):
    docs = edge.withColumnRenamed("source", "lang_pred")
    got = sorted((r.doc_id or 0, r.text or "") for r in keep_identified(docs).collect())
    assert got == sorted((i or 0, t or "") for i, t in EDGE if t and any(map(str.isalpha, t))) and keep_identified(docs).columns == docs.columns
    assert keep_identified(docs.limit(0)).count() == 0 and keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_foreign_labels_cost_no_document(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", "quality")
    foreign = labels.selectExpr("doc_id", "5 AS quality").unionByName(labels.selectExpr("doc_id", "CAST(NULL AS int) AS quality")).unionByName(labels.selectExpr("doc_id", "-1 AS quality"))
    want, got = (score_quality(docs, x).orderBy("doc_id").toPandas() for x in (labels, labels.unionByName(foreign)))
    assert got.equals(want) and got.score.nunique() > 10
