"""The Merkle manifest against plain lists, with rounds of every height."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from metricwell.llm.merkle import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root of a list of nodes and every node's siblings, with whether each stands before."""
    proofs, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(0, len(nodes), 2):
            for k in (i, i + 1):
                if k < len(nodes):
                    other = i + i + 1 - k
                    for leaf_of in held[k]:
                        proofs[leaf_of].append((nodes[other] if other < len(nodes) else "", other < k))
        held = [sum(held[i : i + 2], []) for i in range(0, len(held), 2)]
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return (nodes or [None])[0], proofs


def plain(rows):
    by, subs, out = defaultdict(list), {}, []
    for doc_id, source, lang, n_chars, text in rows:
        by[lang].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), (doc_id, source, lang, n_chars, text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: r[:3])
        subs[lang] = tree([r[2] for r in by[lang]])
    root, above = tree([subs[x][0] for x in langs])
    for n, lang in enumerate(langs):
        for r, proof in zip(by[lang], subs[lang][1], strict=True):
            i, s, g, c, t = r[3]
            changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
            node = leaf(i, s, g, c + 1 if c is not None else None, t) if changed else r[2]
            for sibling, before in proof + above[n]:
                node = digest(sibling, node) if before else digest(node, sibling)
            out.append((i, r[2], subs[lang][0], root, digest(*[x for x, _ in proof + above[n]]), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, g int, node long"


@pytest.mark.parametrize("levels", [2, 8])
def test_against_plain_lists(spark, levels):
    rows = [(i, f"s{i % 3}", ("a", "é", "z", "Z", None)[min(i % 9, 4)], i, f"text {i} é") for i in range(137)]
    rows += [(7, None, "a", None, None), (7, None, "a", None, None), (None, "s", "a", 3, "x" * 100_000), (None, None, None, None, None), (21, "s", "alone", 2**63 - 1, "")]
    rows += [(i, "s", f"l{i}", 1, "t") for i in range(1000, 1011)]  # many languages of one row
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in manifest(docs.repartition(5), levels).collect()), key=str) == plain(rows)


def test_few_rows(spark):
    for n in (0, 1, 3):
        rows = [(i, "s", "en", 1, "t") for i in range(n)]
        got = manifest(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), 2)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


