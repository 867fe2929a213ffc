"""A Merkle manifest of a table: digests of rows, of runs of two, up to one root, and a proof for every row.

Leaves of a language stand in order of their ids; a node's parent is the digest of its run of two (or of it alone where
the level's last run has one node). A node of level j is kept on the row of its first leaf, so that rows stay dense and
the sibling is always 2 ** j rows ahead or behind: lead where the node is the first of its run, lag where it is the
second, neither where the run has one node. First-child rows hash the parents. On the way down the same offsets hand
each row the proof of its parent.

Rows are numbered by a range sort with counts of the sorted partitions, never by a window over a language. Windows
cover blocks of 2 ** LEVELS leaves, so LEVELS levels cost one exchange and a language of any size is dealt to many
tasks; the roots of blocks are the leaves of the next round, and 1 / 2 ** LEVELS of the rows. The subroots of the
languages are hashed by the same rounds. Proofs come down round by round, in joins by block. What goes to the driver is
one number a round: the size of the largest language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Levels of the tree within one block of 2 ** LEVELS rows.
LEVELS = 8
#: Where this divides the crc32 of a document's id, the row is tampered with.
TAMPERED = 7
_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _digest(values: list[Column]) -> Column:
    """SHA-256 over "-" for each null and byte count, colon and value for each other value, one after another."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, their place in their group g by order (nulls first), and total, the rows of the group."""
    sort = ["g", *order]
    stored = materialize(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # the sorted partition's number; the lower bits count its rows
    runs = stored.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("g")  # one row for each sorted partition
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    runs = materialize(runs.select("g", "part", "first", before.alias("before"), F.sum("n").over(group).alias("total")))
    pos = F.col("before") + F.col("at") - F.col("first")
    return stored.withColumn("part", part).join(runs, ["g", "part"]).withColumn("pos", pos).drop("at", "part", "first", "before")


def hash_blocks(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """rows (g, pos, total, node and others) with path, the proof inside the row's block, lowest sibling first, and top.

    A step of the path is a sibling (empty where the node is alone in its run) and whether it stands before the node.
    top is the block's topmost node, on the block's first row.
    """
    block = Window.partitionBy("g", "block").orderBy("pos")
    keep, up = rows.columns, rows.withColumn("block", F.shiftright("pos", levels)).withColumn("n0", F.col("node"))
    place, total = F.col("pos"), F.col("total")
    masks = []
    for j in range(levels):
        size = 1 << j
        index = F.shiftright(place, j)
        first, here = index.bitwiseAND(F.lit(1)) == 0, place.bitwiseAND(F.lit(size - 1)) == 0
        run = F.least(F.lit(2), F.ceil(total / size) - index + index.bitwiseAND(F.lit(1)))  # nodes of the row's run
        more = total > size  # the level has more than one node
        near = F.when(first, F.lead(f"n{j}", size).over(block)).otherwise(F.lag(f"n{j}", size).over(block))
        up = up.withColumn(f"s{j}", F.when(here & more, F.when(run == 2, near).otherwise(F.lit(""))))
        parent = F.when(more, F.sha2(F.concat(f"n{j}", f"s{j}"), 256)).otherwise(F.col(f"n{j}"))
        up = up.withColumn(f"n{j + 1}", F.when(here & first, parent))
        masks.append((first, here, more))
    step = "array<struct<sibling: string, before: boolean>>"
    down = up.withColumn(f"p{levels}", F.when(F.col(f"n{levels}").isNotNull(), F.array().cast(step)))
    for j in reversed(range(levels)):
        first, here, more = masks[j]
        above = F.when(first, F.col(f"p{j + 1}")).otherwise(F.lag(f"p{j + 1}", 1 << j).over(block))
        own = F.array(F.struct(F.col(f"s{j}").alias("sibling"), (~first).alias("before"))).cast(step)
        down = down.withColumn(f"p{j}", F.when(here, F.when(more, F.concat(own, above)).otherwise(above)))
    return down.select(*keep, F.col("p0").alias("path"), F.col(f"n{levels}").alias("top"))


def _rounds(rows: DataFrame, levels: int) -> list[DataFrame]:
    """hash_blocks of rows, of the tops of their blocks, and so on, until every group is one block."""
    out, size = [], 1 << levels
    while True:
        out.append(materialize(hash_blocks(rows, levels)))
        if (out[-1].agg(F.max("total")).first()[0] or 0) <= size:
            return out
        tops = out[-1].where(F.col("top").isNotNull())
        rows = tops.select("g", F.shiftright("pos", levels).alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("node"))


def _proved(rounds: list[DataFrame], groups: DataFrame, levels: int) -> DataFrame:
    """The rows of the first round with their whole paths: through their blocks, then on by the group's (on, and others)."""
    known = groups
    for n, here in enumerate(reversed(rounds)):
        up = ["g"] if n == 0 else ["g", "up"]
        here = here.withColumn("up", F.shiftright("pos", levels)).join(known, up).withColumn("on", F.concat("path", "on")).drop("up", "path")
        known = here.withColumnRenamed("pos", "up").drop("total", "node", "top")
    return here


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row.

    Leaves of a language ascend by doc_id, a null id first, rows of one id by their leaves; languages ascend by the bytes
    of their names, null first. A proof is the digest of the siblings up to the root (of nothing, if there is one row in
    all). Tampering adds 1 to n_chars where TAMPERED divides the crc32 of doc_id; null ids and null n_chars stay as they
    are. folded_root is computed anew for every row, from its leaf or tampered leaf and the siblings. An empty table
    gives an empty result; columns beside those hashed are ignored.
    """
    value = {c: F.col(c) for c in _FIELDS}
    more = value | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    leaves = docs.select(*_FIELDS).select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("g"),
        "doc_id",
        _digest([*value.values()]).alias("node"),
        F.when(tampered, _digest([*more.values()])).alias("changed"),
    )
    rounds = _rounds(_numbered(leaves, ["doc_id", "node"]), levels)
    subroots = rounds[-1].where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("node"))
    above = _rounds(_numbered(subroots, ["name"]), levels)
    root = above[-1].where("pos = 0").select("g", F.col("top").alias("root"), F.array().cast("array<struct<sibling: string, before: boolean>>").alias("on"))
    named = _proved(above, root, levels).select(F.col("name").alias("g"), F.col("node").alias("subroot"), "root", "on")
    rows = _proved(rounds, materialize(named), levels)
    folded = F.aggregate(
        "on",
        F.coalesce("changed", "node"),
        lambda node, step: F.sha2(F.when(step["before"], F.concat(step["sibling"], node)).otherwise(F.concat(node, step["sibling"])), 256),
    )
    proof = F.sha2(F.array_join(F.col("on.sibling"), ""), 256)
    out = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
         sha256({" || ".join(map(_field, _FIELDS))}) AS leaf,
         sha256({" || ".join(_field("CAST(n_chars AS DECIMAL(20, 0)) + 1" if c == "n_chars" else c) for c in _FIELDS)}) AS changed,
         flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) & 1))) AS bits
  FROM documents),
n AS (
  SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295, bits),
                lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b)))) % {TAMPERED} = 0 THEN changed ELSE leaf END AS given
  FROM d),
up AS (
  SELECT g, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY g) AS total FROM n
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(h || coalesce(after, '')), (total + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY idx) AS after FROM up WHERE total > 1) WHERE idx % 2 = 0),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM up WHERE total = 1),
top AS (
  SELECT 0 AS level, pos AS idx, h, count(*) OVER () AS total FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, sha256(h || coalesce(after, '')), (total + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS after FROM top WHERE total > 1) WHERE idx % 2 = 0),
steps AS (
  SELECT u.g, u.level, u.idx, CASE WHEN u.idx % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM up u LEFT JOIN up s ON s.g = u.g AND s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.total > 1),
last AS (
  SELECT t.level, t.idx, CASE WHEN t.idx % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM top t LEFT JOIN top s ON s.level = t.level AND s.idx = xor(t.idx, 1) WHERE t.total > 1),
high AS (
  SELECT sub.g, sub.h AS subroot, coalesce(list(last.step ORDER BY last.level) FILTER (last.step IS NOT NULL), []) AS path
  FROM sub LEFT JOIN last ON last.idx = sub.pos >> last.level GROUP BY ALL),
low AS (
  SELECT n.doc_id, n.g, n.pos, n.leaf, n.given, coalesce(list(steps.step ORDER BY steps.level) FILTER (steps.step IS NOT NULL), []) AS path
  FROM n LEFT JOIN steps ON steps.g = n.g AND steps.idx = n.pos >> steps.level GROUP BY ALL),
p AS (
  SELECT doc_id, leaf, given, subroot, (SELECT h FROM top WHERE total = 1) AS root, list_concat(low.path, high.path) AS path
  FROM low JOIN high USING (g)),
f AS (
  SELECT *, list_reduce(list_prepend(given, path),
              lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM f
"""
