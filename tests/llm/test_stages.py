"""Stages of the pipeline against brute force."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from metricwell.llm.language_id import FEWEST, STRAYS, KernelClassifier, excerpts, identify_languages, sample
from tests.llm.test_models import bags, similarity


def test_line_dedup_removes_whole_repeated_runs(spark):
    draw, rows = random.Random(7), []
    passages = [[f"passage {n} {j} line {k}" for k in range(n)] for n in range(2, 9) for j in range(6)]
    for i in range(60):
        parts = [[f"own {i} {j} {k}" for k in range(draw.randint(0, 2))] + draw.choice(passages) for j in range(draw.randint(1, 4))]
        rows.append((i, "\n".join([x for p in parts for x in p] + [f"end {i}", "same single line"][: draw.randint(0, 2)])))
    rows += [(100, "x\nx\nx\ny"), (101, "a\n\n\nb"), (102, "c\n\n\nd"), (103, None), (104, "x\nown\nx"), (105, passages[-1][0]), (None, "x\ny"), (None, "own null\nx\nx")]
    seen, want = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] != "x\ny")):
        lines = (text or "").split("\n")
        gone = set()
        for a in range(len(lines)):  # by its first line, so that an earlier line of the same text counts as earlier
            runs = [tuple(lines[a:b]) for b in range(a + 2, len(lines) + 1) if any(lines[a:b])]
            for run in runs:
                if run in seen:
                    gone |= set(range(a, a + len(run)))
            seen |= set(runs)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left.strip():
            want[i, text] = text if not gone else left
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert len(got) == len(want) and sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for (i, _), t in want.items())
    assert all(r.n_chars == len(r.text or "") for r in got) and len(got) < len(rows)


def test_language_id_scores_every_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    junk = [
        (9001, "xqzj kkwv zzqx wvkq jjxz qqkw zvxj " * 9),
        (9002, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 20),
        (9003, "12 34 !!"),
        (9004, None),
    ]
    docs = docs.unionByName(
        spark.createDataFrame([(i, t, None, "s", 1) for i, t in junk], "doc_id long, text string, lang string, source string, n_chars long")
    )
    texts, labels = sample(docs)
    model = KernelClassifier.fit(texts, labels)

    def best(text, model=model):  # one text at a time, n-gram by n-gram
        code = " ".join(text.lower().split())
        columns = model.columns([text])[0]
        grams = {int(columns[n - 1][i]) for n in (1, 2, 3) for i in range(len(code) - n + 1)}
        each = [model.weights[model.place[g]] for g in grams]
        margin = (np.sum(each, axis=0) if each else 0.0) / np.sqrt(max(len(grams), 1)) + model.weights[-1]
        return margin.max() - model.weights[-1][margin.argmax()], len(grams), model.languages[int(margin.argmax())]

    right = {}
    for k in (0, 1):
        half = KernelClassifier.fit(texts[k::2], labels[k::2])
        for i, (t, lang) in enumerate(zip(*excerpts(texts[1 - k :: 2], labels[1 - k :: 2]), strict=True)):
            if any(map(str.isalpha, t)):
                m, n, got = best(t, half)
                if got == lang:
                    right.setdefault(int(np.log2(n)), []).append((m, i < len(texts[1 - k :: 2])))

    def floor(n):
        held = [b for b in right if b <= int(np.log2(max(n, 1))) and len(right[b]) >= FEWEST]
        if not held:
            return -np.inf
        every, whole = sorted(m for m, _ in right[max(held)]), [m for m, w in right[max(held)] if w]
        low = every[len(every) // STRAYS]
        return min([low, *whole])
    want, all_ids = set(), {}
    for r in docs.collect():
        all_ids[r.doc_id] = r.text
        m, n, _ = best(r.text or "")
        if any(map(str.isalpha, r.text or "")) and m >= floor(n) - 1e-5:
            want.add(r.doc_id)
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, data).collect()}
    assert not got ^ want, [(i, best(all_ids[i] or "")[:2], floor(best(all_ids[i] or "")[1])) for i in got ^ want]
    assert not got & {9001, 9003, 9004} and len(got) >= 0.99 * (len(all_ids) - len(junk))


def test_near_dedup_keeps_one_of_each_class(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets, root = bags([r.text for r in rows]), {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(zip(root, sets, strict=True), 2):
        if s and t and similarity(s, t) >= 0.8 - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()} == {i for i in root if find(i) == i}


def test_languages_beyond_the_64_commonest_are_learnt(spark):
    rows = [(70 * k + j, f"l{j:02d}", f"text {k}") for k in range(6) for j in range(70)]
    texts, labels = sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert set(labels) == {f"l{j:02d}" for j in range(70)} and len(texts) == len(labels)


def test_minority_scripts_are_told_apart(spark):
    draw, rows = random.Random(3), []
    words = {
        "la": "abcdefghijklmnopqrstuvwxyz0123456789àâçéèêëîïôûùüÿñæœäöß.,;:!?()",
        "el": "αβγδεζηθικλμνξοπρστυφχψω",
        "ru": "абвгдежзийклмнопрстуфхцчшщыэюя",
    }
    for i in range(330):
        lang = "la" if i % 11 < 9 else ("el", "ru")[i % 2]
        rows.append((i, lang, " ".join("".join(draw.choices(words[lang], k=6)) for _ in range(200 if lang == "la" else 4))))
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string")).toPandas().set_index("doc_id")
    assert all(got.lang_pred[i] == lang for i, lang, _ in rows)


def test_the_pipeline_learns_from_every_row(spark):
    from metricwell.llm import language_id

    draw, words = random.Random(2), {"aa": [f"ab{i}o" for i in range(300)], "bb": [f"ba{i}u" for i in range(300)]}
    rows = [(i, "ab"[i % 4 == 0] * 2, " ".join(draw.choices(words["ab"[i % 4 == 0] * 2], k=12))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    every = sample(docs, per_language=10_000)
    assert len(every[0]) > len(sample(docs)[0])  # more rows than a sample of SAMPLE a language holds
    numbered = language_id.numbered(docs.repartition(5))
    got = [r.text for r in numbered.orderBy("number").collect()]
    assert got == every[0] and [r.number for r in numbered.orderBy("number").collect()] == list(range(len(got)))
    shown = every[0][::50]
    for model, k in zip(language_id.fit_all(numbered), (slice(None), slice(0, None, 2), slice(1, None, 2)), strict=True):
        want = KernelClassifier.fit(every[0][k], every[1][k])
        assert model.languages == want.languages and np.allclose(model.margins(shown), want.margins(shown), atol=1e-4)
