"""Near-duplicate detection by BagMinHash signatures of five-word shingles, banding and verified multiset overlap.

A text is the multiset of its word shingles; two texts are near copies if the weighted Jaccard similarity of these
multisets (sum of the smaller counts over sum of the larger counts) is 0.8 or more, and classes are the connected
components of that relation.

Signature: every shingle has a Poisson process on (time x weight); the weight axis is cut into the dyadic intervals
[0,1), [1,2), [2,4), [4,8) ... Each interval's points come in order of time, at a rate equal to the interval's length,
each with a random register and a place found by halving the interval; points at places below the shingle's count
belong to the text. A register keeps the earliest time it gets, and a process ends once its time passes the latest of
the text's registers. Two texts agree in a register with a probability equal to their weighted Jaccard similarity.

Steps: (1) one pass makes, for each text, a digest of its word sequence and the bands of its signature; (2) equal
digests are folded into one representative; (3) representatives that share a band are a bucket, and texts are compared
inside buckets only; (4) verified links are joined into classes by large-star and small-star rounds, on identifiers.

Comparing goes on in rounds, and a pair whose texts are in one class already is not compared again. The first round
takes the buckets of EARLY bands, which joins most copies; the second all other buckets that still hold more than one
class, those with equal members once. A hot bucket is split: its blocks of bounded texts and shingles are one task each,
all of them with the bucket's first text, to which most copies are similar; a third round compares what is still apart
from a hot bucket's largest class with all blocks of the bucket. So every pair that shares a band has been compared or
is in one class, and no bucket lands in one task. Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, join_keyed, materialize, small_batches, table
from .words import mix, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of ROWS registers: two texts at similarity 0.8 share no band with probability (1 - 0.8 ** 4) ** 28 < 4e-7.
BANDS, ROWS = 28, 4
#: Bands of the first round.
EARLY = 4
#: Texts and shingles of a block (about; a hash deals them); a task compares one or two blocks.
BLOCK, ITEMS = 512, 1_000_000
_U = np.uint64


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count, doc) of the distinct shingles of every text, and 16-byte digests of the word sequences."""
    hashes, first = word_hashes([x.lower() for x in texts])
    n, words = len(texts), np.diff(first)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], words)
    digest = np.zeros((n, 2), dtype=_U)
    for half, salt in enumerate((0x51ED270B, 0x7FEB352D)):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes + mix(place.astype(_U) * _U(2) + _U(salt))), dtype=_U)))
        digest[:, half] = mix(total[first[1:]] - total[first[:-1]] + words.astype(_U))
    grams, at = shingles(hashes, first, SHINGLE)
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])))) if len(grams) else np.zeros(0, np.int64)
    return grams[new], np.diff(np.concatenate((new, [len(grams)]))), doc[new], digest


def signatures(gram: np.ndarray, count: np.ndarray, doc: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash registers (n x size) of n multisets; infinite where a multiset is empty."""
    registers = np.full(n * size, np.inf)
    level = np.frexp(count.astype(np.float64) - 0.5)[1].clip(0) + 1  # a count of c reaches into that many intervals
    who = np.repeat(np.arange(len(gram)), level)
    k = np.arange(len(who)) - np.repeat(level.cumsum() - level, level)
    seed, doc, most = mix(gram[who] + mix(k.astype(_U) + _U(77))), doc[who], count[who]
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    wide = np.maximum(low, 1)
    time, step = np.zeros(len(who)), 0
    while len(who):
        step += 1
        draw = mix(seed + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(draw >> _U(11)).astype(np.float64) * 2.0**-53) / wide
        draw = mix(draw ^ _U(0xD6E8FEB86659FD93))
        place = low + ((draw >> _U(33)).astype(np.int64) * wide >> 31)  # its leading bits choose halves, one after another
        slot = doc * size + (draw & _U(0xFFFFFFFF)).astype(np.int64) % size
        mine = place < most
        np.minimum.at(registers, slot[mine], time[mine])
        latest = registers.reshape(n, size).max(axis=1)
        go = np.flatnonzero(time < latest[doc])
        who, seed, doc, most, low, wide, time = (x[go] for x in (who, seed, doc, most, low, wide, time))
    return registers.reshape(n, size)


def _bands(registers: np.ndarray) -> np.ndarray:
    """(n x BANDS) hashes of groups of registers; the last bits of the times, which may differ by machine, are left out."""
    bits = (registers.view(_U) + _U(1 << 15)) >> _U(16)
    out = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(bits), 1))
    for r in range(ROWS):
        out = mix(out * _U(5) + bits[:, r::ROWS][:, :BANDS])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        gram, count, doc, digest = multisets(texts)
        full = np.bincount(doc, minlength=len(texts)) > 0
        bands = _bands(signatures(gram, count, doc, len(texts)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x.tobytes() for x in digest], pa.binary()),
                pa.array([b if f else [] for b, f in zip(bands, full, strict=True)], pa.list_(pa.int64())),
                pa.array(np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)),
            ],
            ["doc_id", "digest", "bands", "items"],
        )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multisets as sets: the j-th of equal shingles is an element of its own, so overlaps are plain intersections."""
    for batch, texts in chunks(batches):
        gram, count, doc, digest = multisets(texts)
        nth = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
        item = mix(np.repeat(gram, count) + mix(nth.astype(_U) + _U(13)))
        ends = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64).cumsum()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x.tobytes() for x in digest], pa.binary()),
                pa.array([x.tobytes() for x in np.split(item, ends[:-1])], pa.binary()),
            ],
            ["digest", "items"],
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): root is the smallest node.

    Alternates large-star (link each larger neighbour to the smallest neighbour) and small-star (link the smaller
    neighbours to the smallest); the number of rounds grows with the logarithm of the longest path. Only a count of
    changes goes to the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs)
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct())
        # settled: every node has one link, and no root is linked further
        links, nodes = new.agg(F.count("*"), F.count_distinct("a")).first()
        pairs = new
        if links == nodes and new.select("b").distinct().join(new.select("a").distinct(), F.col("b") == F.col("a"), "left_semi").isEmpty():
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


def spanning_links(items: list[np.ndarray], known: list | None = None, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of least or more that connect what all such pairs connect.

    known: the classes that the sets are in already (each in its own, if not given). Sets are compared one after
    another with all others, those of the largest class last; a comparison is left out only where both sets are in one
    class by then, so no connection is missed.
    """
    n = len(items)
    size = np.array([len(x) for x in items], dtype=np.int64)
    value, code, seen = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = seen > 1
    column, keep = (np.cumsum(shared) - 1)[code], shared[code]
    owner, column = np.repeat(np.arange(n), size)[keep], column[keep]
    bits = np.zeros((n, max(int(shared.sum() + 63) // 64, 1)), dtype=_U)
    np.bitwise_or.at(bits, (owner, column >> 6), _U(1) << (column & 63).astype(_U))
    group = np.arange(n) if known is None else np.unique(np.array(known, dtype=object), return_inverse=True)[1]
    links, left = [], np.ones(n, dtype=bool)
    for c in np.argsort(np.bincount(group)[group], kind="stable").tolist():
        left[c] = False
        near = np.flatnonzero(left & (group != group[c]) & (size >= least * size[c] - 1e-9) & (size * least <= size[c] + 1e-9))
        mine = np.flatnonzero(bits[c])
        if not len(near) or not len(mine):
            continue
        common = np.bitwise_count(bits[np.ix_(near, mine)] & bits[c][mine]).sum(axis=1, dtype=np.int64)
        for x in near[common >= least * (size[c] + size[near] - common) - 1e-9].tolist():
            if group[x] != group[c]:
                links.append((c, x))
                group[group == group[x]] = group[c]
    return links


def _compare(rows: pa.Table) -> pa.Table:
    """Classes that similar texts of a task join: each with the smallest class that it is joined to."""
    nodes, items, known = (rows[c].to_pylist() for c in ("digest", "items", "root"))
    first = {d: i for i, d in reversed([*enumerate(nodes)])}  # the first text of a bucket may be there twice
    items, known = [items[i] for i in first.values()], [known[i] for i in first.values()]
    head: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while head.get(x, x) != x:
            head[x] = head.get(head[x], head[x])
            x = head[x]
        return x

    for i, j in spanning_links([np.frombuffer(x, dtype=_U) for x in items], known):
        low, high = sorted((find(known[i]), find(known[j])))
        head[high] = low
    pairs = [(x, find(x)) for x in head]
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})


def _apart(buckets: DataFrame, classes: DataFrame | None, block: int, least: int = 1) -> DataFrame | None:
    """The members of buckets that hold more than one class, with their class (root), the bucket's blocks (k) and first text.

    Buckets are not joined back to their rows by a shuffle where they are hot. Of buckets with equal members one is left.
    Buckets of fewer than least blocks are left out before rows are joined; None if no bucket is left.
    """
    members = buckets.withColumn("root", F.col("digest"))
    if classes is not None:
        members = buckets.join(classes.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    members = materialize(members)
    told = members.groupBy("band").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("all"),
        F.min("digest").alias("first"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("digest")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(5), "digest")).alias("y"),
    )
    one = told.where("low <> high").groupBy("n", "x", "y", "first").agg(F.min(F.struct("band", "all")).alias("b"))
    k = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("b.all") / ITEMS), F.lit(1)).cast("int")
    one = materialize(one.select("b.band", "n", "first", k.alias("k")).where(F.col("k") >= least))
    return None if one.isEmpty() else materialize(join_keyed(members, one, ["band"], "n"))


def _joined(classes: DataFrame | None, tasks: DataFrame, items: DataFrame) -> DataFrame:
    """classes (node, root) after the texts inside each task (band, i, j) have been compared. tasks: digest and root too."""
    links = materialize(tasks.join(items, "digest").groupBy("band", "i", "j").applyInArrow(_compare, "a binary, b binary"))
    new = components(links)
    if classes is None:
        return materialize(new)
    own = new.select(F.col("node").alias("root"), F.col("root").alias("further"))
    old = classes.join(own, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return materialize(old.unionByName(new.join(classes, "node", "left_anti")))


def similar_classes(buckets: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of the classes that all pairs of similar texts in one bucket make; a text without such is not there.

    buckets: band, number (of the band), digest, size (shingles); items: digest, items (their hashes as bytes).
    """
    own = F.pmod(F.xxhash64("digest"), F.col("k")).cast("int")
    classes = None
    for some in (buckets.where(F.col("number") < EARLY), buckets):
        here = _apart(some, classes, block)
        if here is None:
            continue
        at = here.select("band", "digest", "root", own.alias("i"), F.lit(0).alias("j"))
        firsts = here.where("digest = first AND k > 1").select(
            "band",
            "digest",
            "root",
            F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"),
            F.lit(0).alias("j"),
        )
        classes = _joined(classes, at.unionByName(firsts), items)
    hot = _apart(buckets, classes, block, 2)
    if hot is None:
        return buckets.select(F.col("digest").alias("node"), F.col("digest").alias("root")).limit(0) if classes is None else classes
    sizes = hot.groupBy("band", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("band").agg(F.max(F.struct("m", "root")).alias("b"), F.sum("m").alias("n"))
    main = materialize(main.select("band", "n", F.col("b.root").alias("main"), F.ceil((F.col("n") - F.col("b.m")) / block).cast("int").alias("rest")))
    both = join_keyed(hot.drop("n"), main, ["band"], "n")
    mine, grid = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("rest")).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = both.where("root <> main").select("band", "digest", "root", mine.alias("i"), grid("k").alias("j"))
    every = both.select("band", "digest", "root", grid("rest").alias("i"), own.alias("j"))
    return _joined(classes, rest.unionByName(every), items)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, class_size, copies (rows with the same words), kept (the row that stays), for each row.

    class_id is the smallest doc_id of the class (null ids come last). Words are lower-cased runs of letters, digits
    and "_". A text of one to four words is one shingle; texts without words, null texts included, are one class of
    equal texts. Rows repeated with the same doc_id share their fate. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(texts.mapInArrow(_sign, "doc_id long, digest binary, bands array<long>, items long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    reps = materialize(
        signed.groupBy("digest").agg(F.any_value("bands").alias("bands"), F.any_value("items").alias("size"), F.count("*").alias("copies"), first)
    )
    every = reps.select("digest", "size", F.posexplode("bands").alias("number", "band"))
    often = every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # a text is in BANDS buckets, so no bucket holds more than one in BANDS of these rows
    buckets = materialize(every.join(often.select("band").hint("merge"), "band", "left_semi"))

    wanted = buckets.select("digest").distinct().join(reps, "digest").select(F.col("first.doc_id").alias("id")).distinct()
    items = materialize(
        texts.join(
            wanted,
            F.col("doc_id").eqNullSafe(F.col("id")),
            "left_semi",
        ).mapInArrow(_elements, "digest binary, items binary").dropDuplicates(["digest"])
    )
    linked = similar_classes(buckets, items, block)

    of = materialize(
        reps.select("digest", "copies", "first").join(
            linked.withColumnRenamed("node", "digest"),
            "digest",
            "left",
        ).withColumn("root", F.coalesce("root", "digest"))
    )
    whole = materialize(of.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min("first").alias("f"), F.count("*").alias("n")))
    named = join_keyed(of, whole, ["root"], "n").select("digest", "copies", "class_size", F.col("f.doc_id").alias("class_id"))
    return join_keyed(signed, materialize(named), ["digest"], "copies").select(
        "doc_id",
        "class_id",
        "class_size",
        "copies",
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"),
    )


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
