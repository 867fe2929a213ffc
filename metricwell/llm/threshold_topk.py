"""Exact top-k inner-product search by Fagin's threshold algorithm, block by block.

Candidates are cut into blocks, queries into blocks; each pair of blocks is one row of a grid and one piece of work.
In it the candidates of each dimension stand in a list sorted by component. For a query the lists are read from the
end that its own component favours; every vector met for the first time is scored in full. The sum over the dimensions
of (query component x the component last read in that list) bounds the score of all vectors not met, and reading stops
when that bound is below the k-th score (it goes on at equality, for a tie may hold a smaller identifier).

Blocks share the k-th score: each query first meets one block, and takes the k-th score found there along to all others,
where it stops the reading sooner. Lists are sorted once for a block and QUERIES queries. How much of a block is left
unread depends on the vectors: with a few strong dimensions most of it, with many dimensions of equal weight nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Candidates and queries in a block; they bound a task's memory and do not change the result.
BLOCK, QUERIES = 8192, 1024
#: Entries read from each list between two looks at the bound.
STEP = 64
_EXACT, _LONG = 1 << 53, 1 << 63


def _pack(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """Rows (block, dims, name): the vectors of a block as bytes: row numbers (uid), vec_ids, components, floors."""
    parts = ("uids", "ids", "values", "floors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids, floors, block = (np.asarray(batch.column(c)) for c in ("uid", "vec_id", "floor", "block"))
            values = batch.column("v")
            width = np.diff(np.asarray(values.offsets))
            flat = np.asarray(values.flatten(), dtype=np.int64)
            starts = np.asarray(values.offsets)[:-1] - values.offsets[0].as_py()
            out: dict[str, list] = {c: [] for c in ("block", "dims", *parts)}
            for b, d in sorted({*zip(block.tolist(), width.tolist(), strict=True)}):
                rows = np.flatnonzero((block == b) & (width == d))
                out["block"].append(b)
                out["dims"].append(d)
                for c, x in zip(parts, (uids[rows], ids[rows], flat[(starts[rows][:, None] + np.arange(d)).ravel()], floors[rows]), strict=True):
                    out[c].append(x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c in ("block", "dims") else pa.binary()) for c, x in out.items()], [*out])

    packed = df.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    packed = packed.mapInArrow(pack, "block int, dims int, uids binary, ids binary, values binary, floors binary")
    return packed.groupBy("block", "dims").agg(F.collect_list(F.struct(*parts)).alias(name))


def _matrix(parts: list[dict], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, vec_ids, components and floors, by vec_id."""
    uids, ids, floors = (np.concatenate([np.frombuffer(p[c], np.int64) for p in parts]) for c in ("uids", "ids", "floors"))
    rows = np.concatenate([np.frombuffer(p["values"], np.int64) for p in parts]).reshape(len(ids), dims)
    order = np.lexsort((uids, ids))
    return uids[order], ids[order], rows[order], floors[order]


def threshold_top_k(query: np.ndarray, own: int, rows: np.ndarray, lists: np.ndarray, k: int, floor: int = -_LONG, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best rows for one query, and how many rows were scored.

    Of equal scores the smaller position comes first; the row at position own doesn't count; rows that score below
    floor may be left out. lists[d] holds the positions ordered by component d, ascending.
    """
    n, used = len(rows), np.flatnonzero(query)
    weight = query[used]
    met = np.zeros(n, dtype=bool)
    if 0 <= own < n:
        met[own] = True
    best, score, depth, seen = np.zeros(0, np.int64), np.zeros(0, rows.dtype), 0, 0
    while depth < n:
        upto = min(n, depth + step)
        if len(used) == 0:
            fresh, last, depth = np.flatnonzero(~met), None, n
        else:
            down, up = lists[:, n - upto : n - depth][used[weight > 0]], lists[:, depth:upto][used[weight < 0]]
            mark = np.zeros(n, dtype=bool)
            mark[down.ravel()] = True
            mark[up.ravel()] = True
            fresh = np.flatnonzero(mark & ~met)
            edge = np.where(weight > 0, lists[used, n - upto], lists[used, upto - 1])
            last = (rows[edge, used] * weight).sum()
            depth = upto
        met[fresh] = True
        seen += len(fresh)
        found = rows[fresh] @ query
        if found.dtype == object:  # exact integers; beyond a long they saturate
            found = np.array([max(-_LONG, min(_LONG - 1, x)) for x in found], dtype=object)
        best = np.concatenate((best, fresh))
        score = np.concatenate((score, found))
        if len(best) > k:
            keep = np.lexsort((best, -score))[:k]
            best, score = best[keep], score[keep]
        if met.all() or last is not None and last < max(floor, score.min() if len(best) >= k else -_LONG):
            break
        step *= 2
    order = np.lexsort((best, -score))[:k]
    return best[order], score[order], seen


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Every cell of the grid: query (its row number), query_id, vec_id, score, and scored, of, rows of the block."""
    for batch in batches:
        for cell in batch.to_pylist():
            d = cell["dims"]
            uids, ids, have, _ = _matrix(cell["c"], d)
            asking, qids, queries, floors = _matrix(cell["q"], d)
            biggest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (have, queries)]
            most = biggest[0] * biggest[1] * max(d, 1)
            if most < _EXACT:  # integers that a float type holds exactly; its products are faster
                have, queries = (x.astype(np.float32 if most < 1 << 24 else np.float64) for x in (have, queries))
            elif most >= _LONG:
                have, queries = have.astype(object), queries.astype(object)
            lists = np.argsort(have.T, axis=1, kind="stable").astype(np.int32) if d else np.zeros((0, len(ids)), np.int32)
            place = {u: i for i, u in enumerate(uids.tolist())}
            found = [threshold_top_k(q, place.get(u, -1), have, lists, k, f) for u, q, f in zip(asking.tolist(), queries, floors.tolist(), strict=True)]
            size = [len(f[0]) for f in found]
            columns = (
                np.repeat(asking, size),
                np.repeat(qids, size),
                ids[np.concatenate([f[0] for f in found])],
                np.concatenate([f[1] for f in found]).astype(np.int64),
                np.repeat([f[2] for f in found], size),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "score", "scored"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """The k best-scoring other rows for each row whose vec_id is divisible by every.

    Components become floor(scale * x), at most what a long holds; the score is the exact integer inner product, which
    saturates at a long's ends (and is a tie there); ties go to the smaller vec_id. Null vec_ids, null vectors and
    vectors with null or non-finite components take no part, on either side; vectors of different lengths are not
    compared; a query without partners gives no row. Rows are told apart, not their vec_ids: of repeated rows each is a
    query of its own, with the others among its candidates. An empty table gives an empty result. Other columns are
    ignored.
    """
    small = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = materialize(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("vec_id").cast("long").alias("vec_id"),
            small.alias("v"),
        )
    )
    count = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    wide, high = max(1, math.ceil(count[0] / block)), max(1, math.ceil(count[1] / QUERIES))
    cells = lambda: F.sequence(F.lit(0), F.lit(wide - 1))
    asked = rows.where(F.col("vec_id") % every == 0)
    left = materialize(_pack(rows.withColumn("floor", F.lit(-_LONG).cast("long")), wide, "c"))
    shape = "query long, query_id long, vec_id long, score long, scored long"

    def meet(queries: DataFrame, blocks) -> DataFrame:
        right = _pack(queries, high, "q").withColumnRenamed("block", "row").withColumn("block", F.explode(blocks))
        return left.join(right, ["block", "dims"]).repartition(wide * high, "row", "block").mapInArrow(lambda batches: _search(batches, k), shape)

    start = materialize(meet(asked.withColumn("floor", F.lit(-_LONG).cast("long")), F.array(F.col("row") % wide)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    local = start
    if wide > 1:
        floor = start.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(
            F.col("query").alias("uid"),
            F.col("score").alias("floor"),
        )
        known = asked.join(floor, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(-_LONG).cast("long")))
        local = start.unionByName(meet(known, F.filter(cells(), lambda b: b != F.col("row") % wide)))
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.uid <> c.uid),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
