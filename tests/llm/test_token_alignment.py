"""Alignment of tokenizers against plain loops, with the tokenizer file that names the vocabulary."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from metricwell.llm import token_alignment as T

SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "<s> x </s>", "<unk>", "<0x41>"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level entry shows as they are
    code = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(sorted(set(range(256)) - set(shown)))}

    def spans(text):
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        wa = [bytes(code[c] for c in a.id_to_token(i)) for i in ia]
        wb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        raw = (" " + (text or "")).encode()
        return (list(zip(ia, wa)), list(zip(ib, wb))) if text and b"".join(wa) == raw == b"".join(wb) else ([], [])

    return spans


def brute(rows, spans):
    seen, per = Counter(), []
    for doc_id, text in rows:
        cuts, links, groups = [], [], []
        sides = spans(text)
        ranges = []
        for side in sides:
            at, mine = 0, []
            for i, w in side:
                mine.append((i, at, at + len(w)))
                at += len(w)
            ranges.append(mine)
        cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        for i, s, e in ranges[0]:
            links += [(i, j) for j, t, f in ranges[1] if max(s, t) < min(e, f)]
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo < e <= hi) for side in ranges))
        seen.update(links)
        per.append((doc_id, len(ranges[0]), len(ranges[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, b), n in seen.items():
        most[b] = max(most[b], n)
    return sorted(((i, a, b, g, len(k), sum(seen[x] == most[x[1]] for x in k), sum(seen[x] for x in k), h) for i, a, b, g, k, h in per), key=str)


def test_against_plain_loops(spark, data, plain):
    draw = random.Random(5)
    odd = ["", " ", None, "x", "  two  spaces ", "▁ ▁x", "line\nbreak\t tab", "é中文рус \U0001f600", "7" * 300, "中" * 400, "x\x00y", *SPECIAL, *SPECIAL]
    odd += ["".join(draw.choice("ab \n.é中\U0001f600'0<|>") for _ in range(draw.randint(1, 60))) for _ in range(200)]
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if len(r.text) < 3000][:60]
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(odd + texts)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, block int, code string")
    want = brute(rows, plain)
    for size in (500, T.BLOCK_CHARS):
        got = sorted((tuple(r) for r in T.align_tokenizers(docs, block_chars=size).collect()), key=str)
        assert got == want
    assert any(r[3] < r[1] for r in want) and sum(r[1] > 0 for r in want) > 200


def test_registered_query(spark, data, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = T.op11_token_alignment(spark, data).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.n_links.eq(got.n_a + got.n_b - got.n_groups).all()
    for doc_id, text in rows[::9]:
        a, b = plain(text)
        assert (got.n_a[doc_id], got.n_b[doc_id]) == (len(a), len(b))
    assert T.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_are_the_common_ends():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 5000):
        for few in (0.01, 0.5, 0.99):
            size = draw.integers(1, n + 1, 4).cumsum() + n
            a, b = (np.unique(np.concatenate((np.flatnonzero(draw.random(size[-1]) < (few if side else 0.5)) + 1, size))) for side in (0, 1))
            stop = np.searchsorted(a, size) + 1
            assert (T.shared_cuts(a, b, np.concatenate(([0], stop[:-1])), stop) == np.isin(a, b)).all()


def test_a_long_stretch_without_a_cut(plain):
    a, b = np.arange(2, 200_001, 2), np.append(np.arange(1, 199_999, 2), 200_000)
    assert T.shared_cuts(a, b, np.array([0]), np.array([len(a)])).sum() == 1
