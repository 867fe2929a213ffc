"""A stored inverted index: postings bucketed by term, statistics of terms and of the corpus, added to segment by segment."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch, shared_folder, state_of
from .text import DELTA, K1, B, nfkc, tokens

#: Parts of a term's postings, by a hash of the document; a term of every document is that many keys and not one.
SHARDS = 16
_COMMITS = "name string, segment string, buckets int, n long, words long"


def bitmaps(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, bucket, bits): the candidates (query_id, key) of each query, one bit for each in 32,768 ids at a time."""
    number = F.col(key).cast("long")
    placed = candidates.select("query_id", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("at"))
    return placed.groupBy("query_id", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def among(rows: DataFrame, bits: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (query_id, key and others) whose key is a candidate of their query by bitmaps."""
    number = F.col(key).cast("long")
    names = rows.columns
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("bucket", F.bitmap_bucket_number(number)).join(bits, ["query_id", "bucket"])
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*names)


class TermIndex:
    """An index in a folder of its own, which a later session may open again by its path.

    Tables: postings (term, shard, doc_id, tf, dl, segment), bucketed by term and shard, so that queries meet them
    without shuffling them; terms (term, df, max_tf, min_dl, segment), from which a bound on any score follows; commits
    (name, segment, buckets, n, words), one row for each segment, written last. add() reads and writes its own segment
    only; df, n and the mean length are sums over the segments, so that an index of several segments scores like one
    built at once. Only committed segments are read: what an add that was cut short has left is never seen, and of two
    that added the same name at once one counts.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark)
        self.table = f"postings_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.createDataFrame([], _COMMITS).write.mode("ignore").parquet(f"{self.path}/commits")
        self.segments = self._committed()
        kept = {r["buckets"] for r in self.segments.values()}
        self.buckets = min(kept) if kept else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if kept and not spark.catalog.tableExists(self.table):
            self._register()

    @classmethod
    def of_table(cls, docs: DataFrame, buckets: int | None = None) -> TermIndex:
        """The index kept for what the table docs holds now; one of its earlier files is never taken for it."""
        return cls(docs.sparkSession, buckets, f"{shared_folder(docs.sparkSession)}/index-{state_of(docs)}")

    def _committed(self) -> dict[str, Row]:
        rows = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").collect()  # a row for each segment
        return {r["name"]: r for r in sorted(rows, key=lambda r: r["segment"], reverse=True)}

    def _register(self) -> None:
        """Makes the stored postings known to the catalog of a session that has not written them."""
        types = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.path}/postings").schema} | {"segment": "string"}
        columns = ", ".join(f"`{n}` {t}" for n, t in types.items())
        self.spark.sql(
            f"CREATE TABLE {self.table} ({columns}) USING parquet PARTITIONED BY (segment) "
            f"CLUSTERED BY (term, shard) SORTED BY (term, shard) INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings'"
        )
        self.spark.catalog.recoverPartitions(self.table)

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str | None = None) -> TermIndex:
        """Adds the documents (key, text), none of which is there already. A null text has no words, but counts.

        name: of the segment; one that is there already is left as it is, and nothing is read.
        """
        if name in self.segments:
            return self
        segment = uuid.uuid4().hex
        words = docs.select(F.col(key).alias("doc_id"), tokens(nfkc(F.col(text))).alias("w"))
        each = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
        # dealt by the bucket's columns, which the grouping takes as they lie: one shuffle, one file for a bucket
        found = each.repartition(self.buckets, "term", "shard").groupBy("term", "shard", "doc_id", "dl").agg(F.count("*").alias("tf"))
        writer = found.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment")
        writer.bucketBy(self.buckets, "term", "shard").sortBy("term", "shard").option("path", f"{self.path}/postings").saveAsTable(self.table)
        own = self.spark.table(self.table).where(F.col("segment") == segment)
        of_shard = own.groupBy("term", "shard").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sum("tf").alias("words"))
        self._merged(of_shard, F.sum("words").alias("words")).withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.path}/terms")
        count = self._all_terms().where(F.col("segment") == segment).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        row = docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(count))
        row = row.select(F.lit(name or segment).alias("name"), F.lit(segment).alias("segment"), F.lit(self.buckets).alias("buckets"), "n", "words")
        row.write.mode("append").parquet(f"{self.path}/commits")
        self.segments = self._committed()
        return self

    @staticmethod
    def _merged(terms: DataFrame, *more: Column) -> DataFrame:
        return terms.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), *more)

    def _all_terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, max_tf long, min_dl int, words long, segment string").parquet(f"{self.path}/terms")

    def _known(self) -> Column:
        return F.col("segment").isin([r["segment"] for r in self.segments.values()])

    def postings(self) -> DataFrame:
        return self.spark.table(self.table).where(self._known())

    def terms(self) -> DataFrame:
        return self._merged(self._all_terms().where(self._known()))

    def size(self) -> DataFrame:
        """(n, avgdl), one row."""
        rows = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").where(self._known())
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("words"), F.sum("n")).alias("avgdl"))

    def stats(self) -> DataFrame:
        """(documents, avg_length, vocabulary), one row."""
        return self.size().select(F.col("n").alias("documents"), F.round("avgdl", 6).alias("avg_length")).crossJoin(self.terms().agg(F.count("*").alias("vocabulary")))

    @staticmethod
    def _weight(tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl"))) + DELTA

    def weighted(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, term) with idf, avgdl and bound, above which no document's score for the term lies."""
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        rows = asked.join(self.terms(), "term").crossJoin(F.broadcast(self.size())).withColumn("idf", idf)
        return rows.select("query_id", "term", "idf", "avgdl", (F.col("idf") * self._weight(F.col("max_tf"), F.col("min_dl"))).alias("bound"))

    def hits(self, asked: DataFrame) -> DataFrame:
        """Postings of the terms asked for, with query_id, idf and avgdl; only the asking side moves."""
        shards = F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard")
        return self.postings().join(self.weighted(asked).select("query_id", "term", "idf", "avgdl", shards), ["term", "shard"])

    def scores(self, asked: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of BM25+ for every document with a term of the query (query_id, term).

        candidates: (query_id, doc_id) that may be scored for a query, applied before anything is summed; idf and mean
        length stay those of the whole index. A query without a candidate finds nothing.
        """
        parts = self.hits(asked).select("query_id", "doc_id", (F.col("idf") * self._weight(F.col("tf"), F.col("dl"))).alias("part"))
        if candidates is not None:
            parts = among(parts, bitmaps(candidates))
        return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))

    def top(self, asked: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        """scores with rank, the k best of each query, ties to the smaller doc_id."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return self.scores(asked, candidates).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def terms_of(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term) of queries (query_id, text); a query's terms count once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(nfkc(F.col(text))))).alias("term"))
