"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is described by its form alone (pairs of character
classes, word lengths, repetition of words in it and of word triples in the document), encoded by a learned layer, and
weighted by gated attention: a = softmax over the document of w . (tanh(V h) * sigmoid(U h)). The weighted sum of the
encoded passages is scored by a logistic unit. Encoder, attention and unit are learned together from document labels,
on the driver, from a bounded sample; no passage has a label of its own. Scoring reads all passages of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, small_batches, table
from .words import mix, spans

PASSAGE = 512
#: Labelled documents of each class to learn from (about; a hash chooses them), passages of one, and of all together.
#: Longer documents, and those beyond the sum, are left out of the sample whole; all texts are scored whole.
SAMPLE, LONGEST, PASSAGES = 1500, 4096, 100_000
_CLASSES = 8


def _classes() -> np.ndarray:
    kind = np.full(256, 5, dtype=np.int64)  # 5: symbols
    kind[[*b" \t\r\0"]] = 0
    kind[ord("\n")] = 1
    kind[[*b"abcdefghijklmnopqrstuvwxyz"]] = 2
    kind[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 3
    kind[[*b"0123456789"]] = 4
    kind[[*b".,;:!?'\"-()"]] = 6
    kind[128:] = 7
    return kind


_KIND = _classes()
FEATURES = _CLASSES * _CLASSES + 6


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES) and each text's first passage. Every text has a passage, the empty one too."""
    raw, begin, end, hashes, at = spans(texts)
    count = -(-np.diff(at) // PASSAGE)
    first = np.concatenate(([0], count.cumsum()))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    place = first[doc] + (np.arange(len(raw)) - at[doc]) // PASSAGE
    kind, n = _KIND[raw], int(first[-1])
    pair = np.bincount(place[1:] * 64 + kind[:-1] * 8 + kind[1:], minlength=n * 64).reshape(n, 64)
    size = np.maximum(np.bincount(place, minlength=n), 1)[:, None]
    home, owner = place[begin], doc[begin]
    words = np.bincount(home, minlength=n)
    least = np.maximum(words, 1)
    long = np.bincount(home, weights=end - begin, minlength=n) / least

    def repeated(of: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether the same hash stands in the same group at another place too."""
        code = mix(of + mix(where.astype(np.uint64) + np.uint64(1)))
        _, back, seen = np.unique(code, return_inverse=True, return_counts=True)
        return seen[back] > 1

    share = lambda flag: np.bincount(home, weights=flag, minlength=n) / least
    again = np.concatenate(
        (hashes[1:] == hashes[:-1], [False])
    ) & np.concatenate((owner[1:] == owner[:-1], [False])) if len(hashes) else np.zeros(0, bool)
    triple = hashes * np.uint64(3) + np.roll(hashes, -1) * np.uint64(5) + np.roll(hashes, -2) * np.uint64(7)
    extra = (
        words / size[:, 0] * 6,
        long / 8,
        share(repeated(hashes, home)),
        share(again),
        share(repeated(mix(triple), owner)),
        np.log1p(np.diff(at))[np.repeat(np.arange(len(texts)), count)] / 10,
    )
    return np.hstack((np.sqrt(pair / size), np.stack(extra, axis=1))).astype(np.float32), first


class AttentionModel:
    """Encoder, gated attention and logistic unit, with the standardisation of their input."""

    def __init__(self, seed: int = 7, width: int = 24, gate: int = 12):
        r = np.random.default_rng(seed)
        make = lambda a, b: r.normal(0, a**-0.5, (a, b))
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "E": make(FEATURES, width),
            "e": np.zeros(width),
            "V": make(width, gate),
            "U": make(width, gate),
            "w": make(gate, 1)[:, 0],
            "c": make(width, 1)[:, 0],
            "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, doc = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh((x - self.mean) / self.std @ p["E"] + p["e"])
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (a * g) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, first[:-1])[doc])
        s /= np.add.reduceat(s, first[:-1])[doc]
        z = np.add.reduceat(s[:, None] * h, first[:-1], axis=0)
        return {"doc": doc, "h": h, "a": a, "g": g, "s": s, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        """Adam on the balanced logistic loss over all bags at once."""
        if len(label) == 0 or label.min() == label.max():
            self.p["c"][:] = 0
            self.p["b"][:] = 0 if len(label) == 0 else (4 if label[0] else -4)
            return self
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 0.02
        weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(label)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, rounds + 1):
            p, grad = self.p, self.gradient(x, first, label, weight)
            for k, gr in grad.items():
                gr = gr + decay * p[k] * (k in "EVUwc")
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.99 * v[k] + 0.01 * gr * gr
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of all bags, by each parameter."""
        p, f = self.p, self.forward(x, first)
        dy = (f["y"] - label) * weight
        part = (dy[:, None] * p["c"])[f["doc"]]
        da = (part * f["h"]).sum(axis=1)
        ds = f["s"] * (da - np.add.reduceat(f["s"] * da, first[:-1])[f["doc"]])
        dag = ds[:, None] * p["w"]
        dta, dtg = dag * f["g"] * (1 - f["a"] ** 2), dag * f["a"] * f["g"] * (1 - f["g"])
        dh = (f["s"][:, None] * part + dta @ p["V"].T + dtg @ p["U"].T) * (1 - f["h"] ** 2)
        scaled = (x - self.mean) / self.std
        return {
            "E": scaled.T @ dh,
            "e": dh.sum(axis=0),
            "V": f["h"].T @ dta,
            "U": f["h"].T @ dtg,
            "w": (f["a"] * f["g"]).T @ ds,
            "c": f["z"].T @ dy,
            "b": np.array([dy.sum()]),
        }

    def score(self, texts: list[str]) -> np.ndarray:
        x, first = encode(texts)
        return self.forward(x, first)["y"]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> AttentionModel:
    """A model from a bounded sample of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = labels.where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("quality") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < share).limit(3 * per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            x, first = encode(texts)
            parts = [x[a:b].tobytes() if b - a <= LONGEST else None for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.binary())],
                ["doc_id", "quality", "bag"],
            )

    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    bags, left = [], PASSAGES
    for r in wanted.mapInArrow(run, "doc_id long, quality int, bag binary").where("bag IS NOT NULL").toLocalIterator():
        left -= len(r["bag"]) // (4 * FEATURES)
        if left < 0:
            break
        bags.append((r["doc_id"], r["quality"], bytes(r["bag"])))
    bags.sort()
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for *_, b in bags]
    first = np.concatenate(([0], np.cumsum([len(b) for b in x], dtype=np.int64)))
    return AttentionModel().fit(np.concatenate([*x, np.zeros((0, FEATURES), np.float32)]), first, np.array([q for _, q, _ in bags], dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Only the text is an input of a score; empty and null texts are one empty passage. Labels other than 0 and 1 and
    null labels are ignored; of several labels of a document the larger counts. Without labels all scores are 0.5, with
    labels of one class all lean to that class. Repeated rows get equal scores, a null doc_id counts as not held out,
    an empty table gives an empty result, and other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(texts))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
