"""SimHash classes against comparing all pairs; the Golay hash over all of its syndromes."""

import random
from itertools import combinations

import numpy as np
import xxhash

from metricwell.llm import golay_simhash as G


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = np.array(sorted(root), dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            a, b = find(int(fps[i])), find(int(fps[j]))
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in root}


def test_near_vectors_share_an_index():
    """Of all syndromes and all errors of up to two bits; the code is linear, so this covers all pairs of vectors."""
    errors = np.array([sum(1 << b for b in bits) for w in range(3) for bits in combinations(range(23), w)])
    for leader in G._ERRORS[:, 0]:
        own = set(G.indices(np.array([leader]))[0].tolist()) - {-1}
        assert all(own & set(row) for row in G.indices(errors ^ leader).tolist())
    assert sorted({int((row >= 0).sum()) for row in G._ERRORS}) == [1, 6]


def test_fingerprints_within_four_bits_share_a_key():
    draw = random.Random(1)
    for n in range(3000):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), n % 5):
            b ^= 1 << bit
        key, owner = G.fuzzy_keys(np.array([a, b], dtype=np.uint64))
        assert set(key[owner == 0]) & set(key[owner == 1]) and len(set(key[owner == 0])) == (owner == 0).sum()


def test_cases_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 50)
    draw = random.Random(2)
    base = [" ".join(draw.choice("alpha beta Gamma delta ÉÀ x1 y2 z3 w4".split()) + str(draw.randrange(30)) for _ in range(draw.randint(1, 80))) for _ in range(40)]
    texts = [None, "", " \t\n", "one", "One", "one two\x0bthree", "ONE  TWO three", "a b c d", "a b c d e", " ", "x" * 300_000, "word " * 5000, "É", "é"]
    for t in base:
        words = t.split()
        for _ in range(6):
            copy = list(words)
            copy[draw.randrange(len(copy))] = "changed"
            texts += [" ".join(copy), t, t.upper()]
    rows = [(None if i % 50 == 49 else i // 2, t) for i, t in enumerate(texts)]
    got = G.simhash_classes(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, key int")).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    of, least = plain_classes({f for _, f in fps}), {}
    for i, f in fps:
        least.setdefault(of[f], []).extend([] if i is None else [i])
    want = [(i, f"{f:016x}", min(least[of[f]], default=None)) for i, f in fps]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)) and len(least) < len(of)
    assert G.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_are_split_and_nothing_is_lost(spark):
    draw, fps = random.Random(4), set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(150):
            fp = centre
            for bit in draw.sample(range(draw.choice((6, 64))), draw.randint(0, 4)):
                fp ^= 1 << bit
            fps.add(fp)
    chain = draw.getrandbits(64)
    for bit in draw.sample(range(64), 60):
        chain ^= 1 << bit
        fps.add(chain)
    table = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    want = plain_classes(fps)
    for block in (5, 40):
        root = {f: f for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in G.links(table, block).collect():
            assert ((a ^ b) & (2**64 - 1)).bit_count() >= 1
            a, b = find(a % 2**64), find(b % 2**64)
            root[max(a, b)] = min(a, b)
        assert {f: find(f) for f in fps} == want


def test_registered_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    of, least = plain_classes(set(fps.values())), {}
    for i, f in fps.items():
        least[of[f]] = min(i, least.get(of[f], i))
    assert sorted(map(tuple, G.op13_golay_simhash(spark, data).collect())) == sorted((i, f"{f:016x}", least[of[f]]) for i, f in fps.items())
