"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Only documents longer than a sequence are cut. A piece as long as a sequence has one to itself; the others are dealt
by hash to islands of about ISLAND pieces, one task each. A chromosome is a list of bins, and since pieces of equal
length are alike, a bin is the list of its lengths. Crossover injects whole well-filled bins of one parent into the
other, removes the bins that would use a piece twice, and best-fits the pieces so displaced: each, longest first, into
the kept bin that it leaves least room in, and what fits into none into new bins. After a first spell every island
passes its fullest bins on to the next one; these take part in the crossover of the second spell wherever the receiver
owns pieces of those lengths. Pieces never leave their island, so no task or driver sees all of them.
"""

from __future__ import annotations

import math
import os
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_CHARS, chunks, materialize, small_batches, table

#: Tokens of a sequence; id that ends a document; pieces of an island.
SEQUENCE, END, ISLAND = 2048, 0, 16384
#: Chromosomes of an island, offspring of a spell, offspring in a row that better nothing before it ends, and migrants.
POPULATION, OFFSPRING, PATIENCE, MIGRANTS = 8, 64, 16, 64
#: Words whose ids a Python worker remembers; it forgets the later half when there are more.
REMEMBERED = 1_100_000
#: Kinds of bytes of UTF-8: ASCII signs, the apostrophe, ASCII letters and digits, first bytes of U+00C0 to U+017F.
_SIGN, _APOSTROPHE, _ALNUM, _LATIN = 1, 2, 3, 4
_KIND = bytearray(256)
for _c in range(33, 127):
    _KIND[_c] = _APOSTROPHE if _c == ord("'") else _ALNUM if chr(_c).isalnum() else _SIGN
_KIND[0xC3:0xC6] = bytes([_LATIN]) * 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lower(text: str) -> str:
    """Lower case, as the tokenizer makes it too, of texts in Latin-1; others are left to the tokenizer."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _apart(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """Texts with a space between letters or digits and ASCII signs, where the tokenizer cuts too.

    Before a letter an apostrophe may be part of a token, so nothing goes between these. Beyond ASCII, letters of Latin-1
    and Latin Extended-A count, save the one whose lower case ends in a mark.
    """
    _, offsets, data = texts.buffers()
    if not data or not data.size:
        return texts
    data = b"  %b  " % data.to_pybytes()
    raw, kind, at = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KIND), np.uint8), np.frombuffer(offsets, np.int64)

    def letter(i: np.ndarray) -> np.ndarray:
        """Whether a letter of two bytes begins at i."""
        code = (raw[i].astype(np.int32) & 31) << 6 | raw[i + 1] & 63
        return (kind[i] == _LATIN) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)

    sign = np.flatnonzero(kind - 1 < _APOSTROPHE)  # a sign or an apostrophe: 0 less 1 is 255
    before = sign[(kind[sign - 1] == _ALNUM) | letter(sign - 2)]
    after = sign[kind[sign] == _SIGN] + 1
    after = after[(kind[after] == _ALNUM) | letter(after)]
    gaps = np.sort(np.concatenate((before, after))) - 2
    spaced = np.insert(raw[2:-2], gaps, ord(" "))
    at = at[: len(texts) + 1]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at + np.searchsorted(gaps, at)), pa.py_buffer(spaced))


class WordTokenizer:
    """Token ids of texts as little-endian bytes, by a tokenizer that drops white space and never joins over it.

    Words between white space and signs are encoded once and remembered; what could depend on more than the word (special
    tokens, separators that only Python takes for white space) is encoded as a whole text. Words of lower-case letters
    go through the same model without the steps that leave them as they are: normalizing and the search for words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.model, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.model._resize_cache(0)  # each word comes once
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = np.zeros(self.model.get_vocab_size() + 1, dtype=bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str], letters: bool = False) -> list[np.ndarray]:
        """Ids without the offsets that nobody asks for."""
        model = self.letters if letters else self.model
        return [np.array(e.ids, dtype="<u4") for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        return self._ids([text])[0].tobytes()

    def _learn(self, words: list[str]) -> None:
        known, respelled, simple, other = self.known, [], set(), []
        for w in words:
            core = w.lower()
            if core.isalpha() and (core.isascii() or max(core) < "Ͱ" and "İ" not in w):
                if core not in known:
                    simple.add(core)
                if core != w:
                    respelled.append((w, core))
            else:
                other.append(w)
        known.update(zip(other, (x.tobytes() for x in self._ids(other)), strict=True))
        order = list(simple)
        if order:  # a word of letters ends with the one token that has the end mark
            ids = self._ids([" ".join(order)], letters=True)[0]
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(order):
                data, ends = ids.tobytes(), (4 * stop).tolist()
                known.update(zip(order, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                known.update(zip(order, (x.tobytes() for x in self._ids(order)), strict=True))
        for w, core in respelled:
            known[w] = known[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words are split and numbered by Arrow, so that Python looks each of them up once for all texts given."""
        plain = [not ("<|" in x or any(c in x for c in "\x1c\x1d\x1e\x1f")) for x in texts]
        lower = pa.array([_lower(x) if p else "" for x, p in zip(texts, plain, strict=True)], pa.large_string())
        split = pc.utf8_split_whitespace(_apart(lower))
        numbered = split.values.dictionary_encode()
        words, which = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED:  # the words met first are the most frequent ones
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        found = list(map(self.known.get, words))
        if lacking := [i for i, f in enumerate(found) if f is None]:
            self._learn([words[i] for i in lacking])
            for i in lacking:
                found[i] = self.known[words[i]]
        ids, size = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        own, first = size[which], (size.cumsum() - size)[which]
        end = np.concatenate(([0], own.cumsum()))
        data = ids[np.arange(end[-1]) + np.repeat(first - end[:-1], own)].tobytes()
        bounds = (4 * end[split.offsets.to_numpy()]).tolist()
        return [data[a:b] if p else self._whole(x) for x, p, a, b in zip(texts, plain, bounds, bounds[1:], strict=False)]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row; END is the last id of a document."""
    path = path or default_tokenizer()
    small_batches(docs.sparkSession)
    shape = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        for batch, texts in chunks(batches, chars=2 * CHUNK_CHARS):
            rows, out = [], []
            for i, data in enumerate(_tokenizers[path].encode(texts)):
                data += np.array([END], dtype="<u4").tobytes()
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    own = data[at : at + 4 * size]
                    rows.append(i)
                    out.append((k, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), shape.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *columns], ["doc_id", *shape])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def best_fit(lengths: Counter, size: int = SEQUENCE) -> list[list[int]]:
    """Bins for a multiset of lengths: the longest piece opens a bin, then the longest that still fits, and so on."""
    left = [0] * (size + 1)
    mask = 0
    for n, c in lengths.items():
        if c:
            left[n] = c
            mask |= 1 << n
    bins = []
    while mask:
        free, own = size, []
        while free and (fits := mask & ((2 << free) - 1)):
            n = fits.bit_length() - 1
            own.append(n)
            free -= n
            left[n] -= 1
            if not left[n]:
                mask ^= 1 << n
        bins.append(own)
    return bins


def fitness(bins: list[list[int]], size: int = SEQUENCE) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean square of the filling."""
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins) / max(len(bins), 1)


def refill(bins: list[list[int]], left: Counter, size: int = SEQUENCE) -> list[list[int]]:
    """bins with the pieces of left: longest first, each where it leaves least room; pieces without room get new bins."""
    free = sorted((size - sum(own), i) for i, own in enumerate(bins))
    bins, rest = [*bins], Counter()
    while free and free[0][0] == 0:
        free.pop(0)
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            at = bisect_left(free, (n, -1))
            if at == len(free):
                rest[n] += 1
                continue
            room, i = free.pop(at)
            bins[i] = [*bins[i], n]
            if room > n:
                insort(free, (room - n, i))
    return bins + best_fit(rest, size)


def crossover(receiver: list[list[int]], donor: list[list[int]], stock: Counter, draw: random.Random, size: int = SEQUENCE) -> list[list[int]]:
    """Half of donor's better filled bins go in whole; bins of receiver that lack a piece then go, their rest is best-fitted."""
    left, child = dict(stock), []

    def put(own: list[int]) -> None:
        for k, n in enumerate(own):
            if left.get(n, 0) == 0:
                for m in own[:k]:
                    left[m] += 1
                return
            left[n] -= 1
        child.append(own)

    full = sorted(donor, key=sum, reverse=True)[: -(-len(donor) // 2)]
    for own in draw.sample(full, k=-(-len(full) // 2)):
        put(own)
    for own in sorted(receiver, key=sum, reverse=True):
        put(own)
    return refill(child, Counter({n: c for n, c in left.items() if c}), size)


def evolve(lengths: list[int], seed: int, first: list[list[int]] | None = None, migrants: list[list[int]] | None = None, size: int = SEQUENCE) -> list[list[int]]:
    """The best chromosome of an island. first: the one it had; migrants: bins of another island.

    It ends as soon as a chromosome has no more bins than all tokens need, which no other could better, or when PATIENCE
    offspring in a row have bettered nothing.
    """
    draw, stock = random.Random(seed), Counter(lengths)
    least = -(-sum(lengths) // size)
    people = [first] if first else [best_fit(stock, size)]
    while len(people[0]) > least and len(people) < POPULATION:  # others open their bins with pieces at random
        left, bins = stock.copy(), []
        some = draw.sample(lengths, k=len(lengths) // 2)
        for n in some:
            if left[n]:
                left[n] -= 1
                own, free = [n], size - n
                for m in draw.sample(some, k=min(8, len(some))):
                    if left[m] and m <= free:
                        left[m] -= 1
                        own.append(m)
                        free -= m
                if free > size // 50:
                    left.update(own)
                else:
                    bins.append(own)
        people.append(bins + best_fit(left, size))
    idle, best = 0, None
    for step in range(OFFSPRING):
        people.sort(key=lambda b: fitness(b, size), reverse=True)
        idle, best = (idle + 1, best) if fitness(people[0], size) == best else (0, fitness(people[0], size))
        if len(people[0]) <= least or idle >= PATIENCE:
            break
        a, b = draw.sample(people, k=2)
        child = crossover(a, migrants if migrants and step % 4 == 0 else b, stock, draw, size)
        if fitness(child, size) > fitness(people[-1], size):
            people[-1] = child
    return max(people, key=lambda b: fitness(b, size))


_SHAPE = "island int, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def _place(rows: pa.Table, bins: list[list[int]]) -> pa.Table:
    """Rows with bin and offset: each place of a bin takes the next row of its length."""
    free = defaultdict(list)
    for i, n in enumerate(rows["length"].to_pylist()):
        free[n].append(i)
    number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, own in enumerate(bins):
        at = 0
        for n in own:
            i = free[n].pop()
            number[i], offset[i] = k, at
            at += n
    return rows.select(
        ["island", "doc_id", "piece", "start", "length", "ids_crc32"]
    ).append_column("bin", pa.array(number)).append_column("offset", pa.array(offset))


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])


def _first_spell(key: tuple, rows: pa.Table) -> pa.Table:
    rows = _in_order(rows)
    return _place(rows, evolve(rows["length"].to_pylist(), key[0].as_py()))


def _second_spell(key: tuple, rows: pa.Table, came: pa.Table) -> pa.Table:
    rows = _in_order(rows)
    lengths, first = rows["length"].to_pylist(), defaultdict(list)
    for k, n in zip(rows["bin"].to_pylist(), lengths, strict=True):
        first[k].append(n)
    return _place(rows, evolve(lengths, key[0].as_py() + 1_000_003, [first[k] for k in sorted(first)], sorted(came["lengths"].to_pylist())))


def pack(docs: DataFrame, path: str | None = None, island: int = ISLAND) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    A null or empty text is one piece holding END. Repeated rows are packed each on their own, null doc_ids are kept,
    an empty table gives an empty result, and other columns are ignored. Negative sequence_ids are the sequences of
    pieces that fill one.
    """
    every = materialize(pieces(docs, path))
    full = every.where(F.col("length") == SEQUENCE).withColumn(
        "sequence_id",
        -1 - F.monotonically_increasing_id(),
    ).withColumn("offset", F.lit(0).cast("long"))
    short = every.where(F.col("length") < SEQUENCE)
    islands = max(1, math.ceil(short.count() / island))
    place = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(islands)).cast("int")
    first = materialize(short.select(place.alias("island"), *short.columns).groupBy("island").applyInArrow(_first_spell, _SHAPE))
    filled = first.groupBy("island", "bin").agg(
        F.sort_array(F.collect_list("length"), asc=False).alias("lengths"),
        F.sum("length").alias("sum"),
    )
    best = Window.partitionBy("island").orderBy(F.desc("sum"), F.desc(F.size("lengths")), "bin")
    elite = filled.withColumn("n", F.row_number().over(best)).where(F.col("n") <= MIGRANTS)
    elite = elite.select(((F.col("island") + 1) % islands).alias("island"), "lengths")
    second = first.groupBy("island").cogroup(elite.groupBy("island")).applyInArrow(_second_spell, _SHAPE)
    done = second.withColumn("sequence_id", F.col("island").cast("long") * (1 << 32) + F.col("bin"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*columns).union(done.select(*columns))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
