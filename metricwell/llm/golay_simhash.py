"""SimHash near-duplicates, found by decoding fingerprint segments with the binary Golay code.

The Golay code has 4,096 words of 23 bits, any two at least 7 bits apart, and every 23-bit vector is at most 3 bits from
one of them. Its fuzzy hash of a vector is the index of each code word at most 4 bits away: one, or six where the
nearest is 3 bits away. Two vectors that differ in at most 2 bits share an index (checked over all syndromes in the
tests). Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most 4:

* a segment has no error: of the other two one has at most 2, so the clean segment and an index of that one agree
  (6 ordered choices); or
* every segment has an error: two have exactly one, so that a half of each is clean, and the third has at most 2, so
  those two halves and an index of the third agree (3 x 2 x 2 choices).

These are the keys: 22 bits taken as they are and 12 bits of an index, about 95 keys for a fingerprint, so that random
fingerprints rarely meet. Each distinct fingerprint is keyed once. Keys are sorted, runs of one key are compared by
popcount, and only links go on: each member of a run's class with its first. A run of more than BLOCK fingerprints is
split by five pieces of its 42 open bits, one of which any two near ones share; what is still longer is compared block
by block, a pair of blocks in each task. Classes are joined over all runs by star rounds, on fingerprints alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bagminhash import components
from .common import chunks, join_keyed, materialize, small_batches, table
from .words import mix

SHINGLE, SEED, ERRORS = 4, 42, 4
#: Fingerprints that a task compares with one another at once.
BLOCK = 16_384
#: Bytes of a text that are cut into words in one go.
PIECE = 1_000_000
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def _remainders(values: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        values = np.where(values >> bit & 1, values ^ (_GENERATOR << (bit - 11)), values)
    return values


def _error_table() -> np.ndarray:
    """For each syndrome the error patterns of at most 4 bits that have it, one or six; the rest of six is -1."""
    out, filled = np.full((2048, 6), -1, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
        for pattern, syndrome in zip(patterns.tolist(), _remainders(patterns).tolist(), strict=True):
            out[syndrome, filled[syndrome]] = pattern
            filled[syndrome] += 1
    return out


_ERRORS = _error_table()
_LOW, _HIGH = _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12)


def indices(vectors: np.ndarray) -> np.ndarray:
    """(n x 6) indices of the code words at most 4 bits from each 23-bit vector; -1 where there are fewer."""
    error = _ERRORS[_LOW[vectors & 0xFFF] ^ _HIGH[vectors >> 12]]
    return np.where(error < 0, -1, (vectors[:, None] ^ error) >> 11)


#: Where segments begin and how many bits they have, and the same of the two halves of each.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
_HALVES = [[(at, 11), (at + 11, n - 11)] for at, n in SEGMENTS]
#: The bits that a kind of key takes as they are, and the segment that it decodes.
_KINDS = [([SEGMENTS[i]], j) for i in range(3) for j in range(3) if i != j]
_KINDS += [([a, b], k) for k in range(3) for a in _HALVES[(k + 1) % 3] for b in _HALVES[(k + 2) % 3]]


def _bits(fp: np.ndarray, at: int, n: int) -> np.ndarray:
    return (fp >> _U(at) & _U((1 << n) - 1)).astype(np.int64)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in fp) of all keys of the fingerprints; a key's upper bits are its kind."""
    decoded = [indices(_bits(fp, *s)) for s in SEGMENTS]
    keys, owner = [], []
    for kind, (whole, segment) in enumerate(_KINDS):
        value = np.full(len(fp), kind, dtype=np.int64)
        for at, n in whole:
            value = value << n | _bits(fp, at, n)
        value <<= 22 - sum(n for _, n in whole)
        rows, columns = np.nonzero(decoded[segment] >= 0)
        keys.append(value[rows] << 12 | decoded[segment][rows, columns])
        owner.append(rows)
    return np.concatenate(keys), np.concatenate(owner)


def _open_pieces() -> np.ndarray:
    """(kinds x 5) masks that deal the bits which a kind of key leaves open to five pieces."""
    out = np.zeros((len(_KINDS), ERRORS + 1), dtype=_U)
    for kind, (whole, _) in enumerate(_KINDS):
        taken = {b for at, n in whole for b in range(at, at + n)}
        free = [b for b in range(64) if b not in taken]
        for p, bits in enumerate(np.array_split(free, ERRORS + 1)):
            out[kind, p] = sum(1 << int(b) for b in bits)
    return out


_PIECES = _open_pieces()


def _cut(raw: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        stop = end.end() if end else len(raw)
        yield raw[at:stop].split()
        at = stop


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's 4-word shingles, repeats included."""
    ones, n, words = np.zeros(64, dtype=np.int64), 0, []

    def count(hashes: list[int]) -> None:
        nonlocal ones, n
        n += len(hashes)
        for i in range(0, len(hashes), 65_536):
            part = np.array(hashes[i : i + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for more in _cut(text.encode("utf-8", "surrogatepass").lower()):
        words += more
        line, ends = b" ".join(words), list(accumulate((len(w) + 1 for w in words), initial=0))
        count([xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(ends, ends[SHINGLE:], strict=False)])
        words = words[-(SHINGLE - 1) :]
    if not n and words:
        count([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        found = np.array([fingerprint(x) for x in texts], dtype=_U).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            fp = batch.column("fp").slice(at, 4096).to_numpy()
            key, owner = fuzzy_keys(fp.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], ["key", "fp"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of long runs, keyed anew by the run's key and each of five pieces of their open bits."""
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        for p in range(ERRORS + 1):
            new = mix(mix(key.view(_U) + _U(p << 60)) ^ (fp.view(_U) & _PIECES[key >> 34, p]))
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(fp)], ["key", "fp"])


def near_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, first) places of the classes that fingerprints at most ERRORS bits apart make; no link for single ones."""
    members, firsts, left = [], [], np.arange(len(fp))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            step = max(1, (1 << 22) // len(left))
            for i in range(0, len(front), step):
                near |= (np.bitwise_count(fp[front[i : i + step], None] ^ fp[left]) <= ERRORS).any(axis=0)
            front, left = left[near], left[~near]
            members.append(front)
            firsts.append(np.full(len(front), root))
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(members or none), np.concatenate(firsts or none)


_FOUND = "key long, a long, b long"


def _found(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([keys, pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["key", "a", "b"])


def _runs(block: int):
    """Rows sorted by key to links (key null, a and b fingerprints), and to the members of runs longer than block (b: place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, wait = None, 0, np.zeros(0, dtype=np.int64)  # key of the open run, its members given out, those kept
        for batch in batches:
            if not len(batch):
                continue
            fp = np.concatenate((wait, batch.column("fp").to_numpy()))
            key = np.concatenate((np.full(len(wait), last if last is not None else 0, dtype=np.int64), batch.column("key").to_numpy()))
            start = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            size, given = np.diff(np.append(start, len(key))), done if key[0] == last else 0
            if given and len(start) > 1:  # the rest of a long run
                yield _found(key[: size[0]], fp[: size[0]], given + np.arange(size[0]))
                start, size, given = start[1:], size[1:], 0
            yield from whole(key, fp, start[:-1], size[:-1])
            last, wait, done = key[-1], fp[start[-1] :], given
            if done + len(wait) > block:
                yield _found(np.full(len(wait), last), wait, done + np.arange(len(wait)))
                done, wait = done + len(wait), wait[:0]
        if len(wait):
            yield from whole(np.full(len(wait), last), wait, np.array([0]), np.array([len(wait)]))

    def whole(key: np.ndarray, fp: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        two = start[size == 2]
        two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(_U)) <= ERRORS]
        members, firsts = [fp[two + 1]], [fp[two]]
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            here = fp[at : at + n]
            if n > block:
                yield _found(key[at : at + n], here, np.arange(n))
                continue
            a, b = near_links(here.view(_U))
            members.append(here[a])
            firsts.append(here[b])
        pairs = np.unique(np.stack((np.concatenate(members), np.concatenate(firsts)), axis=1), axis=0)
        if len(pairs):
            yield _found(None, pairs[:, 0], pairs[:, 1])

    return run


def _compare(rows: pa.Table) -> pa.Table:
    fp = rows["fp"].to_numpy()
    a, b = near_links(fp.view(_U))
    return pa.table({"a": fp[a], "b": fp[b]})


def _bucket(keyed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Links of the short runs, and the members of the long ones (key, fp, place)."""
    out = materialize(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_runs(block), _FOUND))
    return out.where("key IS NULL").select("a", "b"), out.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("b").alias("place"))


def links(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what all pairs of the distinct fingerprints (fp) at most ERRORS bits apart connect."""
    found, long_runs = _bucket(fingerprints.mapInArrow(_key, "key long, fp long"), block)
    if long_runs.isEmpty():
        return found
    more, rest = _bucket(long_runs.select("key", "fp").mapInArrow(_split, "key long, fp long"), block)
    found = found.union(more)
    if rest.isEmpty():
        return found
    sizes = materialize(rest.groupBy("key").agg(F.count("*").alias("n")))
    here = join_keyed(rest, sizes, ["key"], "n").select("key", "fp", "n", F.floor(F.col("place") / block).alias("i"))
    here = here.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    pairs = here.select("key", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return found.union(materialize(pairs.groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long")))


def simhash_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row.

    Words are runs of anything but the six ASCII white-space characters, with A-Z in lower case. A text of one to three
    words is one shingle; texts without words, null ones included, have the fingerprint zero. component_id is the smallest
    doc_id of the component; null ids are passed over where there is another, and rows repeated with the same doc_id share
    their fate only if their fingerprints do. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, "doc_id long, fp long"))
    each = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = components(links(each.select("fp"), block)).withColumnRenamed("node", "fp")
    of = materialize(each.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = materialize(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = materialize(join_keyed(of, whole, ["root"], "members").select("fp", "n", "component_id"))
    return join_keyed(signed, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))
