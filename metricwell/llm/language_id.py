"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct character n-grams of 1 to 3
characters that both contain, divided by the root of the product of their own numbers. A bounded sample of labelled
rows is fitted on the driver: some of them are landmarks; a text's features are its kernel values with the landmarks
times the inverse root of the landmarks' kernel matrix; one ridge regression per language (against the rest) follows.
Every language has landmarks of its own.

N-grams of code points are hashed into the columns of the presence matrix, so that no script or character is folded into
another. Scoring needs only products of matrices: presence (texts x n-grams) times the landmarks' presence (n-grams x
landmarks) times the fitted weights (landmarks x languages), the last two multiplied once, then divided by the text's
own norm. All of a text is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, held_out, materialize, small_batches, table

#: Rows to fit on for each language, characters of all of them together at most (rows are left out whole), landmarks (or
#: LEAST_LANDMARKS for each language, if that is more), ridge.
SAMPLE, SAMPLE_CHARS, LANDMARKS, LEAST_LANDMARKS, RIDGE = 400, 24_000_000, 192, 4, 1e-3
#: Characters up to which a text is a landmark before others are.
LANDMARK_CHARS = 125_000
#: Words of the excerpts by which the lifts of short texts are known.
EXCERPTS = (1, 2, 3, 5, 8, 13, 21, 34, 55)
#: One in STRAYS texts and excerpts of a size may lie below the floor of that size, which takes FEWEST of them at least.
STRAYS, FEWEST = 100, 20
#: Bits of the columns of n-grams of 1, 2 and 3 characters.
_BITS = (14, 16, 18)
_GRAMS = sum(1 << b for b in _BITS)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Landmarks:
    """The landmarks' presence matrix and the inverse root of their kernel matrix: what a text's features need."""

    def __init__(self, texts: list[str]):
        column, first = KernelClassifier.grams(texts)
        used = np.unique(column)
        self.place = np.zeros(_GRAMS, dtype=np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.base = KernelClassifier.presence(texts, self.place, len(used) + 1)
        self.norm = np.sqrt(np.maximum(np.diff(first), 1))
        value, vector = np.linalg.eigh((self.base @ self.base.T).astype(np.float64) / np.outer(self.norm, self.norm))
        good = value > 1e-9 * value.max()
        self.root = vector[:, good] / np.sqrt(value[good])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"base": self.base.astype(np.uint8)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"base": np.ascontiguousarray(state["base"].T, dtype=np.float32).T}

    def features(self, column: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Features and a 1 for the texts whose grams are given; an n-gram's row of the matrix is read where a text has it."""
        common, rows = np.zeros((len(first) - 1, self.base.shape[0])), self.base.T
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            for at in range(a, b, 1 << 14):
                own = self.place[column[at : min(b, at + (1 << 14))]]
                common[i] += rows[own[own > 0]].sum(axis=0)
        kernel = common / self.norm / np.sqrt(np.maximum(np.diff(first), 1))[:, None]
        return np.hstack((kernel @ self.root, np.ones((len(common), 1))))

    def classifier(self, languages: list[str], squares: np.ndarray, sums: np.ndarray, ridge: float = RIDGE) -> KernelClassifier:
        """By the sums over all rows, each weighted by one over its language's rows, of x'x, and of x for each language."""
        fitted = np.linalg.solve(squares + ridge * np.eye(len(squares)), 2 * sums - sums.sum(axis=1, keepdims=True))
        return KernelClassifier(languages, self.place, np.vstack((self.base.T @ ((self.root @ fitted[:-1]) / self.norm[:, None]), fitted[-1:])).astype(np.float32))


class KernelClassifier:
    """Presence kernel with Nystroem features and one-versus-rest ridge regression."""

    def __init__(self, languages: list[str], place: np.ndarray, weights: np.ndarray):
        """place: for each column its row of weights, 0 for those without; row 0 is zero and the last row the bias."""
        self.languages, self.place, self.weights = languages, place, weights

    @staticmethod
    def columns(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of the 1-, 2- and 3-grams that begin at each character of the lower-cased texts, white space folded,
        and each text's first character. An n-gram that would reach into the next text is the caller's to leave out."""
        low = [" ".join(x.lower().split()) for x in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        out, code, base = [], points * _FACTORS[0], 0
        for n, bits in enumerate(_BITS):
            if n:
                code = code[:-1] * _FACTORS[1] + points[n:] * _FACTORS[0]
            out.append(((((code ^ (code >> np.uint64(29))) * _FACTORS[2]) >> np.uint64(64 - bits)).astype(np.int32)) + np.int32(base))
            base += 1 << bits
        return out, np.concatenate(([0], np.cumsum([len(x) for x in low])))

    @classmethod
    def grams(cls, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of every text, as the columns of a sparse presence matrix, and each text's first index."""
        each, first = cls.columns(texts)
        last, found, at = np.zeros(_GRAMS, dtype=np.int64), [], [0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            gram = np.concatenate([c[a : max(a, b - n)] for n, c in enumerate(each)])
            order = np.arange(len(gram))
            last[gram] = order  # an n-gram counts where it stands last
            found.append(gram[last[gram] == order])
            at.append(at[-1] + len(found[-1]))
        return np.concatenate([*found, np.zeros(0, np.int32)]), np.array(at)

    @classmethod
    def presence(cls, texts: list[str], place: np.ndarray, width: int) -> np.ndarray:
        """(texts x width) with 1 where a text contains an n-gram; place gives a column's number, 0 for what is left out."""
        column, first = cls.grams(texts)
        out = np.zeros((len(texts), width), dtype=np.float32)
        out[np.repeat(np.arange(len(texts)), np.diff(first)), place[column]] = 1
        out[:, 0] = 0
        return out

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelClassifier:
        languages, place = sorted(set(labels)), np.zeros(_GRAMS, dtype=np.int32)
        if not languages:
            return cls([], place, np.zeros((2, 0), np.float32))
        turn, seen = [], Counter()
        for label in labels:
            turn.append(seen[label])
            seen[label] += 1
        chosen = sorted(range(len(texts)), key=lambda i: (turn[i], labels[i]))[: max(landmarks, LEAST_LANDMARKS * len(languages))]
        column, first = cls.grams([texts[i] for i in chosen])
        used = np.unique(column)
        place[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        base = cls.presence([texts[i] for i in chosen], place, width)
        norm = np.sqrt(np.maximum(np.diff(first), 1))
        value, vector = np.linalg.eigh((base @ base.T).astype(np.float64) / np.outer(norm, norm))
        good = value > 1e-9 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        feature = []
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            own = np.diff(cls.grams(some)[1])
            kernel = (cls.presence(some, place, width) @ base.T) / norm / np.sqrt(np.maximum(own, 1))[:, None]
            feature.append(kernel @ root)
        x = np.hstack((np.concatenate(feature), np.ones((len(texts), 1))))
        y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        balance = 1 / np.array([labels.count(l) for l in labels])
        fitted = np.linalg.solve(x.T @ (x * balance[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y * balance[:, None]))
        return cls(languages, place, np.vstack((base.T @ ((root @ fitted[:-1]) / norm[:, None]), fitted[-1:])).astype(np.float32))

    def margins(self, texts: list[str]) -> np.ndarray:
        """(texts x languages) values of the one-versus-rest functions."""
        return self.scored(texts)[0]

    def lifts(self, margins: np.ndarray) -> np.ndarray:
        """How far each text's n-grams lift its winner above the winner's margin of an empty text: 0 for foreign scripts."""
        best = margins.argmax(axis=1)
        return margins[np.arange(len(best)), best] - self.weights[-1][best]

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The margins, and the number of distinct n-grams of each text."""
        column, first = self.grams(texts)
        own = np.diff(first)
        some = own > 0
        out = np.tile(self.weights[-1].astype(np.float64), (len(texts), 1))
        if some.any():  # the presence matrix times the weights, over its entries that are not 0
            out[some] += np.add.reduceat(self.weights[self.place[column]], first[:-1][some], axis=0) / np.sqrt(own[some])[:, None]
        return out, own


def lettered(texts: list[str]) -> np.ndarray:
    return np.array([any(c.isalpha() for c in x) for x in texts], dtype=bool)


def sample(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], list[str]]:
    """A bounded sample of rows outside the held-out fold with a language, chosen by a hash of the row."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(42)), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(draw < share).select("text", "lang", draw.alias("draw"), F.length("text").alias("size"))
    found = found.limit(2 * per_language * len(sizes))
    texts, labels, total = [], [], 0
    for r in sorted(found.toLocalIterator(), key=lambda r: (r["draw"], r["lang"], r["text"])):
        if total + r["size"] <= SAMPLE_CHARS:
            texts.append(r["text"])
            labels.append(r["lang"])
            total += r["size"]
    return texts, labels


def excerpts(texts: list[str], labels: list[str], numbers: list[int] | None = None) -> tuple[list[str], list[str]]:
    """The texts, and of each one run of words of every size of EXCERPTS below its own, from places that differ by text:
    by its number, if numbers are given, else by its place."""
    out, named = list(texts), list(labels)
    for i, text, label in zip(numbers or range(len(texts)), texts, labels, strict=True):
        words = text.split()
        for n in EXCERPTS:
            if n < len(words):
                at = i * 7919 % (len(words) - n + 1)
                out.append(" ".join(words[at : at + n]))
                named.append(label)
    return out, named


def numbered(docs: DataFrame) -> DataFrame:
    """number, lang and text of every row outside the held-out fold with a language, numbered in the order of a hash."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(42)), F.lit(1 << 30))
    part = F.shiftright("at", 33)
    rows = materialize(rows.orderBy(draw, "lang", "text").select("lang", "text", F.monotonically_increasing_id().alias("at")))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return rows.withColumn("part", part).join(materialize(parts), "part").select(
        (F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"), "lang", "text"
    )


def _landmarks(rows: DataFrame, languages: int) -> Landmarks:
    """The first rows of every language in turn; texts of more than LANDMARK_CHARS come after the others."""
    n = max(LANDMARKS, LEAST_LANDMARKS * languages)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text") > LANDMARK_CHARS, "number"))
    first = rows.select("lang", "number", turn.alias("turn")).where(F.col("turn") <= n).orderBy("turn", "lang").limit(n).collect()
    found = {r["number"]: r["text"] for r in rows.where(F.col("number").isin([r["number"] for r in first])).select("number", "text").collect()}
    return Landmarks([found[r["number"]] for r in first])


def _added(table: pa.Table) -> pa.Table:
    total: dict[int, np.ndarray] = {}
    for m, x in zip(table["model"].to_pylist(), table["sums"].to_pylist(), strict=True):
        total[m] = total.get(m, 0) + np.frombuffer(x)
    return pa.table({"model": pa.array(total, pa.int32()), "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def fit_all(rows: DataFrame) -> list[KernelClassifier]:
    """Classifiers fitted on all rows of numbered, on those of even and on those of odd numbers.

    Ridge regression needs sums over the rows only: tasks add up their own, and groups of tasks those of each other.
    """
    spark, odd = rows.sparkSession, F.col("number") % 2
    small_batches(spark)
    counts = rows.groupBy("lang").agg(*[F.count(F.when(c, 1)).alias(f"n{m}") for m, c in enumerate((F.lit(True), odd == 0, odd == 1))]).collect()
    weight = [{r["lang"]: 1 / r[f"n{m}"] for r in counts if r[f"n{m}"]} for m in range(3)]
    names = [sorted(w) for w in weight]
    marks = [_landmarks(r, len(w)) if w else None for r, w in zip((rows, rows.where(odd == 0), rows.where(odd == 1)), weight, strict=True)]
    wide = [m.root.shape[1] + 1 if m else 0 for m in marks]
    shared = spark.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((w, w + len(n))) for w, n in zip(wide, names, strict=True)]
        task = 0
        for batch, texts in chunks(batches):
            column, first = KernelClassifier.grams(texts)
            labels, number = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("number").to_numpy()
            task = int(number[0]) % 16
            for m, some in enumerate((np.ones(len(texts), bool), number % 2 == 0, number % 2 == 1)):
                if not some.any():
                    continue
                x, w = np.zeros((int(some.sum()), wide[m])), np.array([weight[m][l] for l in labels[some]])
                size = np.diff(first)[some]
                own = column if m == 0 else column[np.repeat(some, np.diff(first))]
                x = shared.value[m].features(own, np.concatenate(([0], size.cumsum())))
                total[m][:, : wide[m]] += x.T @ (x * w[:, None])
                hot = labels[some][:, None] == np.array(names[m], dtype=object)[None, :]
                total[m][:, wide[m] :] += x.T @ (hot * w[:, None])
        yield pa.RecordBatch.from_pydict(
            {"task": pa.array([task] * 3, pa.int32()), "model": pa.array(range(3), pa.int32()), "sums": pa.array([x.tobytes() for x in total], pa.binary())}
        )

    shape = "model int, sums binary"
    added = rows.select("number", "lang", "text").mapInArrow(run, f"task int, {shape}").groupBy("task").applyInArrow(_added, shape).groupBy("model").applyInArrow(_added, shape)
    sums = {r["model"]: np.frombuffer(r["sums"]) for r in added.toLocalIterator()}
    out = []
    for m in range(3):
        if names[m]:
            s = sums[m].reshape(wide[m], -1)
            out.append(marks[m].classifier(names[m], s[:, : wide[m]], s[:, wide[m] :]))
        else:
            out.append(KernelClassifier.fit([], []))
    return out


def lift_floors(rows: DataFrame, halves: list[KernelClassifier]) -> np.ndarray:
    """For each size of text, the binary logarithm of its distinct n-grams, the lowest lift of a text of a language.

    All rows of numbered and their excerpts are scored by the model of the other half, as a text's lift in a model
    fitted on it says nothing of texts not seen; those that get their own label count. All but one in STRAYS of a size lie
    above its floor, and so do all whole texts: a name or a number may be an excerpt, but seldom a text. A size of which there are fewer than FEWEST takes the floor of
    the next smaller one; sizes below all others have none (-inf). The order statistic is exact: equal lifts are counted,
    a histogram says in which bin it lies, and the bin's own lifts are gone through.
    """
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            labels, number = batch.column("lang").to_pylist(), batch.column("number").to_pylist()
            for k, model in enumerate(shared.value):
                mine = [i for i, n in enumerate(number) if n % 2 != k]
                if not model.languages or not mine:
                    continue
                some, named = excerpts([texts[i] for i in mine], [labels[i] for i in mine], [number[i] // 2 for i in mine])
                m, own = model.scored(some)
                right = lettered(some) & np.array([model.languages[b] == l for b, l in zip(m.argmax(axis=1), named, strict=True)])
                whole = np.arange(len(some)) < len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(sizes(own[right]).astype(np.int32)), pa.array(model.lifts(m)[right]), pa.array(whole[right])], ["size", "lift", "whole"])

    lifts = rows.select("number", "lang", "text").mapInArrow(run, "size int, lift double, whole boolean")
    lifts = materialize(lifts.groupBy("size", "lift").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).withColumn("bin", F.floor(F.col("lift") * 4096)))
    by_bin, by_lift = Window.partitionBy("size").orderBy("bin"), Window.partitionBy("size").orderBy("lift")
    bins = lifts.groupBy("size", "bin").agg(F.sum("n").alias("m")).select(
        "size", "bin", (F.sum("m").over(by_bin) - F.col("m")).alias("below"), F.sum("m").over(by_bin).alias("upto"), F.sum("m").over(Window.partitionBy("size")).alias("all")
    ).withColumn("k", F.expr(f"all div {STRAYS}"))
    at = lifts.join(bins.where("below <= k AND k < upto"), ["size", "bin"]).withColumn("upto", F.col("below") + F.sum("n").over(by_lift))
    low = at.where("upto > k").groupBy("size").agg(F.min("lift").alias("low"), F.first("all").alias("all"))
    least = lifts.groupBy("size").agg(F.min(F.when(F.col("whole"), F.col("lift"))).alias("least"))
    known = {r["size"]: r for r in low.join(least, "size").collect()}
    floors, last = np.full(64, -np.inf), -np.inf
    for b in range(64):
        if b in known and known[b]["all"] >= FEWEST:
            last = known[b]["low"] if known[b]["least"] is None else min(known[b]["low"], known[b]["least"])
        floors[b] = last
    return floors


def sizes(own: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(own, 1).astype(np.float64))[1] - 1


def identify(docs: DataFrame, model: KernelClassifier) -> DataFrame:
    """doc_id, lang_pred and score of every row; see identify_languages."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch, texts in chunks(batches):
            letters = lettered(texts)
            margin = fitted.margins(texts)
            if fitted.languages:
                best = margin.argmax(axis=1)
                odds = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
                score = np.where(letters, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                names = [fitted.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                score, names = np.zeros(len(texts)), ["und"] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the softmax share of the winner) for each row.

    Fitted on rows outside the held-out fold that have a language; lang is used for fitting alone. Null texts and texts
    without a letter get "und" and score 0, as does everything if no labelled row exists. Repeated rows get equal
    results, a null doc_id counts as not held out, ties go to the language first in order, an empty table gives an
    empty result, and other columns are ignored.
    """
    model = KernelClassifier.fit(*sample(docs))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a language by the classifier. The columns stay as they are.

    The classifier and the floors are those of all rows outside the held-out fold that have a language; landmarks alone,
    which span the features, are some of them. Every text is scored. Those that would get "und" go, and those whose lift is below the one of
    lift_floors for their number of distinct n-grams, which texts and excerpts of the languages reach: no language fits
    them. Null texts go; repeated rows share their fate; without any labelled row nothing has a language and all rows go;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(numbered(docs))
    model, *halves = fit_all(rows)
    shared = spark.sparkContext.broadcast((model, lift_floors(rows, halves)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, floors = shared.value
        for batch, texts in chunks(batches):
            keep = lettered(texts) & bool(fitted.languages)
            if fitted.languages:
                margin, own = fitted.scored(texts)
                keep &= fitted.lifts(margin) >= floors[sizes(own)]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
