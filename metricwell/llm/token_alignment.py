"""Alignment of two tokenizers by divide and conquer at shared cuts, with corpus-wide counts of linked tokens.

A text is encoded twice; both token sequences spell the same bytes. A cut is a byte offset at which a token of either
sequence ends. Cuts are found by divide and conquer: of an interval of tokens between two known cuts, the ends near the
middle are looked up among the other sequence's ends by bisection, the nearest shared one becomes a cut, and both halves
go on alike; an interval without one is a leaf, the group. All intervals of all texts of a chunk are halved together, so
a level of the recursion is a few array operations. Inside a group every end of either sequence closes one pair of
overlapping tokens, which are the links.

Counts of pairs: a task gathers about BLOCK_CHARS characters of texts as a block, and writes for each text its distinct
pairs by their places in the block's sorted list of pairs, and that list with its sums. Sums of all blocks give the
counts; a pair comes at most once a block, so that no pair is a hot key, however common it is. Counts go back to the
blocks by pair, and from there to the texts by block. No text is encoded twice, and no table is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, small_batches, table

#: Characters of the texts of a block (about; a longer text is a block of its own chunk).
BLOCK_CHARS = 8_000_000
_PARTS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, code array<long>, total array<long>"


def default_tokenizers() -> tuple[str, str, str]:
    """Rank file and pattern of A (the vocabulary of byte_bpe_50k.json as ranks), model file of B."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model")


class Spelling:
    """The bytes of the tokens of a vocabulary, by id."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(x) for x in tokens], dtype=np.int64)
        self.start = self.width.cumsum() - self.width
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        width = self.width[ids]
        at = width.cumsum() - width
        return self.bytes[np.repeat(self.start[ids] - at, width) + np.arange(width.sum())].tobytes()


class TokenizerPair:
    """Both tokenizers, each with the bytes that its ids stand for."""

    def __init__(self, ranks: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=model)
        by_rank = {rank: token for token, rank in known.items()}
        self.spell_a = Spelling([by_rank.get(i, b"") for i in range(max(by_rank) + 1)])
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.spell_b = Spelling([bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where the text is empty or either spelling differs from space and text."""
        out_a, out_b = [], []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            a = np.array(self.a.encode_ordinary(" " + text) if text else [], dtype=np.int64)
            b, raw = np.array(b, dtype=np.int64), (" " + text).encode()
            same = len(a) and len(b) and self.spell_a.join(a) == raw and self.spell_b.join(b) == raw
            out_a.append(a if same else a[:0])
            out_b.append(b if same else b[:0])
        return out_a, out_b


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each end of A whether B has it too, where the intervals [low, high) of A's tokens are known to end at a cut.

    Both arrays ascend. Each interval looks for a shared end from its middle outwards, over a reach that doubles.
    """
    cut = np.zeros(len(ends_a), dtype=bool)
    cut[high - 1] = True
    while len(low):
        live = high - low > 1
        low, high = low[live], high[live]
        middle, found = (low + high - 2) >> 1, np.full(len(low), -1)
        todo, near, far = np.arange(len(low)), 0, 1
        while len(todo):
            away = np.arange(near, far)
            away = np.stack((-away, away), axis=1).ravel()[1 if near == 0 else 0 :]
            place = middle[todo, None] + away
            inside = (place >= low[todo, None]) & (place < high[todo, None] - 1)
            value = ends_a[place[inside]]
            shared = np.zeros(place.shape, dtype=bool)
            shared[inside] = ends_b[np.searchsorted(ends_b, value)] == value  # B's last end is A's last end
            hit = shared.any(axis=1)
            found[todo[hit]] = place[hit, shared[hit].argmax(axis=1)]
            todo = todo[~hit & inside.any(axis=1)]
            near, far = far, 2 * far + 1
        split = found >= 0
        middle = found[split]
        cut[middle] = True
        low, high = np.concatenate((low[split], middle + 1)), np.concatenate((middle + 1, high[split]))
    return cut


_FIGURES = np.array([list(f"{i:<6}".encode()) for i in range(1 << 16)], dtype=np.uint8)
_LONG = 1 + (np.arange(1 << 16)[:, None] >= np.array([10, 100, 1000, 10000])).sum(axis=1)


def written(a: np.ndarray, b: np.ndarray, cut: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups in words (a1,a2|b1;a3|b2) of all texts in a row, and how long each text's are. last: each text's last B token."""
    stop_a, stop_b = np.flatnonzero(cut) + 1, np.searchsorted(group_b, np.arange(int(cut.sum())), "right")
    begin_b = np.concatenate(([0], stop_b[:-1])) if len(stop_b) else stop_b
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    at_a = np.arange(len(a)) + begin_b[cut.cumsum() - cut]
    at_b = np.arange(len(b)) + stop_a[group_b]
    ids[at_a], ids[at_b] = a, b
    mark[at_a[stop_a - 1]], mark[at_b[stop_b - 1]] = ord("|"), ord(";")
    figures, width = _FIGURES[ids], _LONG[ids]
    figures[np.arange(len(ids)), width] = mark
    width = width + 1
    width[at_b[last]] -= 1
    ends = width.cumsum()[at_b[last]]
    return figures[np.arange(6) < width[:, None]].tobytes(), np.diff(ends, prepend=0)


def align(pair: TokenizerPair, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links) of each text, digests of the groups, and the links: the text's number, the pair's code."""
    ids_a, ids_b = pair.encode(texts)
    size = np.array([[len(a), len(b)] for a, b in zip(ids_a, ids_b, strict=True)], dtype=np.int64).reshape(-1, 2)
    a, b = np.concatenate(ids_a or [np.zeros(0, np.int64)]), np.concatenate(ids_b or [np.zeros(0, np.int64)])
    full = np.flatnonzero(size[:, 0])
    counts, digests = np.zeros((len(texts), 4), dtype=np.int64), [""] * len(texts)
    if not len(full):
        return counts, digests, a, a
    ends_a, ends_b, stop = pair.spell_a.width[a].cumsum(), pair.spell_b.width[b].cumsum(), size.cumsum(axis=0)[full]
    cut = shared_cuts(ends_a, ends_b, stop[:, 0] - size[full, 0], stop[:, 0])
    cuts = ends_a[cut]
    group_b = np.searchsorted(cuts, ends_b)
    open_b = cuts[group_b] != ends_b  # ends inside a group; A's ends and these close one link each
    doc_a = np.repeat(np.arange(len(texts)), size[:, 0])
    of_a = np.searchsorted(ends_a, ends_b[open_b])
    doc = np.concatenate((doc_a, doc_a[of_a]))
    code = np.concatenate((a, a[of_a])) * len(pair.spell_b.width) + b[np.concatenate((np.searchsorted(ends_b, ends_a), np.flatnonzero(open_b)))]
    counts[:, :2] = size
    counts[:, 2] = np.bincount(doc_a[cut], minlength=len(texts))
    counts[:, 3] = np.bincount(doc, minlength=len(texts))
    words, length = written(a, b, cut, group_b, stop[:, 1] - 1)
    at = 0
    for i, n in zip(full.tolist(), length.tolist(), strict=True):
        digests[i] = hashlib.sha256(words[at : at + n]).hexdigest()
        at += n
    return counts, digests, doc, code


def _planes(values: np.ndarray) -> bytes:
    """32-bit values with their first bytes together, then their second bytes and so on: small values compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _aligner(ranks: str, pattern: str, model: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, number = None, TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([pa.field(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in _PARTS.split(", ")])

        def block(held: list, number: int) -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate([x for *_, x, _ in held])
            known, place = np.unique(pairs, return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([x for *_, x in held]), minlength=len(known)).astype(np.int64)
            start = 0
            for ids, counts, digests, n, pair_codes, times in held:
                ends = n.cumsum()
                mine = place[start : start + len(pair_codes)]
                start += len(mine)
                gaps = [np.diff(x, prepend=0) for x in np.split(mine, ends[:-1])]
                columns = [pa.array([task + number] * len(ids), pa.int64()), ids, *(pa.array(c) for c in counts.T), pa.array(digests, pa.string())]
                columns += [pa.array([_planes(x) for x in gaps], pa.binary()), pa.array([_planes(x) for x in np.split(times, ends[:-1])], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(ids), pa.list_(pa.int64())) for _ in range(2))], schema=schema)
            row = {f.name: None for f in schema} | {"block": task + number, "code": known, "total": total}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

        held, size = [], 0
        for batch, texts in chunks(batches):
            pair = pair or TokenizerPair(ranks, pattern, model)
            counts, digests, doc, code = align(pair, texts)
            one, times = np.unique(doc << 32 | code, return_counts=True)
            held.append((batch.column("doc_id"), counts, digests, np.bincount(one >> 32, minlength=len(texts)), one & 0xFFFFFFFF, times))
            size += sum(map(len, texts))
            if size >= block_chars:
                yield from block(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield from block(held, number)

    return run


def _finish(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of a block with the sums over their links, from the counts of the block's pairs, in order of pair."""
    order = np.argsort(counts["code"].to_numpy())
    count, best = counts["n"].to_numpy()[order], counts["best"].to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for gaps, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
        mine, times = _values(gaps).cumsum(), _values(times)
        n_best.append(int(times[best[mine]].sum()))
        count_sum.append(int((times * count[mine]).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def align_tokenizers(docs: DataFrame, tokenizers: tuple[str, str, str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row.

    A encodes a space and the text, B the text, to which it adds the space; strings of special tokens are plain text. A
    link is a token of A and one of B whose bytes overlap; the count of its pair of ids is how many links of the corpus
    hold that pair. n_best: links whose pair has the highest count of its B id, ties included. Texts that are null or
    empty, and those that a tokenizer does not spell as they are, have no tokens: zeros and an empty digest. Rows
    repeated with the same doc_id, and null ids, count like any other. An empty table gives an empty result; other
    columns are ignored. tokenizers: rank file and pattern of A, model file of B, at the same place on all machines.
    """
    small_batches(docs.sparkSession)
    run = _aligner(*(tokenizers or default_tokenizers()), block_chars)
    parts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PARTS))
    blocks = parts.where("code IS NOT NULL")
    linked = blocks.select(F.explode(F.arrays_zip("code", "total")).alias("x")).groupBy(F.col("x.code").alias("code")).agg(F.sum("x.total").alias("n"))
    linked = materialize(linked.withColumn("b", F.col("code") % _size_b(tokenizers)))
    scored = linked.join(linked.groupBy("b").agg(F.max("n").alias("most")), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    told = blocks.select(F.col("block").alias("of"), F.explode("code").alias("code")).join(scored, "code")
    texts = parts.where("code IS NULL").drop("code", "total")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_finish, shape)


def _size_b(tokenizers: tuple[str, str, str] | None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=(tokenizers or default_tokenizers())[2]).get_piece_size()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
