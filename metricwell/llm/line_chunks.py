"""Line deduplication by content-defined chunks, with DataFrame functions only.

Each line has a code (MD5). A polynomial hash rolling over WINDOW line codes decides whether a chunk ends after the
window's last line, so boundaries depend on a few neighbouring lines only, and the same passage falls into the same
chunks wherever it stands in a document. Chunks of two or more lines that occur more than once in all documents go, but
for their first occurrence.

A repeated passage rarely begins and ends at boundaries, and a short one may hold no whole chunk. So matches are then
extended line by line: outside the repeated chunks every pair of neighbouring lines is looked up too, and the lines of a
pair that has occurred earlier go. So a line goes exactly if it stands in a pair of neighbouring lines, of a repeated
chunk or on its own, that occurs earlier; every run of lines that occurs earlier goes whole, and so does one that earlier
texts hold in overlapping parts (a-b and b-c take out a-b-c). Chunks come first because they take out most of the volume:
a passage that a third of all documents share has been reduced to its first occurrence before its pairs are looked at.
Work and memory grow in proportion to the lines of a text.

Codes find what is equal; bytes decide: each code's lines are grouped by their bytes, and a line whose code stands for
two different lines is never taken for another one. All steps but this one and the last work on codes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, materialize, table

#: Lines of a rolling window; a chunk ends where the window's hash leaves 0 modulo DIVISOR.
WINDOW, DIVISOR = 2, 3
_BASE, _PRIME = 1_000_003, 2_147_483_647


def _code(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _number(code: Column) -> Column:
    return F.conv(F.hex(F.substring(code, 1, 4)), 16, 10).cast("long") % _PRIME


def coded(docs: DataFrame) -> DataFrame:
    """row, codes and blank (whether a line holds only white space) of each different row.

    A line's code is null if it stands for another line too.
    """
    lines = docs.select(
        "row",
        F.posexplode(_lines(F.col("text"))).alias("at", "line"),
    ).select("row", "at", "line", _code(F.col("line")).alias("code"))
    different = lines.groupBy("code", "line").agg(F.lit(1).alias("one")).groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    unsure = materialize(different.select("code"))
    out = docs.select(
        "row",
        F.transform(_lines(F.col("text")), _code).alias("codes"),
        F.transform(_lines(F.col("text")), lambda x: F.trim(x, F.lit(" \t\r")) == "").alias("blank"),
    )
    out = materialize(out.dropDuplicates(["row"]))
    if unsure.isEmpty():
        return out
    spots = out.select(
        "row",
        F.posexplode("codes").alias("at", "code"),
    ).join(unsure, "code", "left_semi").groupBy("row").agg(F.collect_list("at").alias("spots"))
    marked = F.transform("codes", lambda c, i: F.when(~F.coalesce(F.array_contains("spots", i), F.lit(False)), c))
    return materialize(out.join(spots, "row", "left").select("row", marked.alias("codes"), "blank"))


def chunked(codes: DataFrame) -> DataFrame:
    """row, at (first line), n (lines) and code of every chunk of two or more lines that are sure and not all blank."""
    hashed = codes.withColumn("h", F.transform("codes", lambda c: F.coalesce(_number(c), F.lit(0))))

    def ends(x: Column, i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(WINDOW - 1, -1, -1):
            value = (value * _BASE + F.coalesce(F.get("h", i - back), F.lit(0))) % _PRIME
        return F.when((value % DIVISOR == 0) | (i == F.size("h") - 1), i)

    cut = hashed.withColumn("cuts", F.array_compact(F.transform("h", ends)))
    pieces = F.transform(
        "cuts",
        lambda end, k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get("cuts", k - 1) + 1).alias("at"),
            (end - F.when(k == 0, F.lit(-1)).otherwise(F.get("cuts", k - 1))).alias("n"),
        ),
    )
    spans = cut.select("row", "codes", "blank", F.explode(F.filter(pieces, lambda p: p["n"] > 1)).alias("p")).select(
        "row",
        "p.at",
        "p.n",
        F.slice("codes", F.col("p.at") + 1, F.col("p.n")).alias("c"),
        F.slice("blank", F.col("p.at") + 1, F.col("p.n")).alias("b"),
    )
    return spans.where(F.exists("b", lambda x: ~x) & F.forall("c", lambda x: x.isNotNull())).select(
        "row",
        "at",
        "n",
        _code(F.array_join(F.transform("c", F.hex), "")).alias("code"),
    )


def paired(codes: DataFrame) -> DataFrame:
    """row, at and code of every pair of neighbouring lines that are sure, not both blank, and in no chunk of dup."""
    def pair(i: Column) -> Column:
        both = F.get("blank", i) & F.get("blank", i + 1)
        return F.when(~both, F.struct(i.alias("at"), _code(F.concat(F.get("codes", i), F.get("codes", i + 1))).alias("code")))

    none = F.array().cast("array<int>")
    inside = F.coalesce(F.flatten(F.transform("dup", lambda d: F.sequence(d["at"], d["at"] + d["n"] - 2))), none)
    every = F.when(F.size("codes") > 1, F.sequence(F.lit(0), F.size("codes") - 2)).otherwise(none)
    pairs = F.transform(F.array_except(every, inside), pair)
    return codes.select("row", F.explode(F.filter(pairs, lambda p: p["code"].isNotNull())).alias("p")).select("row", "p.at", "p.code")


def repeats(seen: DataFrame) -> DataFrame:
    """The rows of seen (row, at, code ...) but for the first of each code: smallest row, then smallest line."""
    seen = materialize(seen)
    first = materialize(seen.groupBy("code").agg(F.count("*").alias("c"), F.min(F.struct("row", "at")).alias("first")).where("c > 1"))
    return join_keyed(seen, first, ["code"], "c").where(F.struct("row", "at") != F.col("first")).drop("code", "c", "first")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns of docs), text without repeated runs, removed_chunks and removed_lines of each row.

    A line goes if it belongs to a run of two or more lines, not all of them blank, that occurs earlier (smaller doc_id,
    null ids last, then smaller line), whatever stands around it; removed_chunks counts the repeated chunks among them.
    A null text counts as empty and stays null; lines whose codes agree but not their bytes stay; a text of one line
    never changes; a document whose lines all go becomes empty. Rows repeated with the same doc_id and text are one
    document and get equal results. An empty table gives an empty result.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("of")).alias("row")
    codes = coded(docs.select("text", row))
    dup = materialize(repeats(chunked(codes)).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("dup")))
    pairs = repeats(paired(codes.join(dup, "row", "left"))).groupBy("row").agg(F.collect_list("at").alias("ats"))
    gone = dup.join(pairs, "row", "full_outer")
    none = F.array().cast("array<int>")
    lines = F.array_union(F.flatten(F.transform("dup", lambda d: F.sequence(d["at"], d["at"] + d["n"] - 1))), none)
    gone = gone.select(
        "row",
        F.coalesce(F.size("dup"), F.lit(0)).alias("chunks"),
        F.array_union(F.coalesce(lines, none), F.coalesce(F.array_union("ats", F.transform("ats", lambda i: i + 1)), none)).alias("lines"),
    )
    out = docs.select(F.struct("*").alias("doc"), row).join(gone.hint("merge"), "row", "left")

    def rest(every: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "lines"), lambda i: F.get(every, i)), "\n")

    # bound to a variable: inside a lambda the text would be split again for every line
    left = F.transform(F.array(_lines(F.col("doc.text"))), rest)[0]
    return out.select(
        "doc",
        F.when(F.col("lines").isNull(), F.col("doc.text")).otherwise(left).alias("text"),
        F.coalesce("chunks", F.lit(0)).cast("long").alias("removed_chunks"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("removed_lines"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated runs, n_lines (of the original), removed_chunks and removed_lines of each row.

    See without_repeats for nulls, ties, repeated rows and empty tables.
    """
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc.doc_id",
        "text",
        F.size(_lines(F.col("doc.text"))).cast("long").alias("n_lines"),
        "removed_chunks",
        "removed_lines",
    )


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, md5(coalesce(text, '')) AS of, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT DISTINCT doc_id, of, lines FROM l),
h AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {_PRIME}) AS h FROM u),
b AS (
  SELECT doc_id, of, lines,
    list_filter(range(len(lines)), lambda i: i = len(lines) - 1 OR
      ((CASE WHEN i = 0 THEN 0 ELSE h[i] END * {_BASE} + h[i + 1]) % {_PRIME}) % {DIVISOR} = 0) AS cuts
  FROM h),
c AS (
  SELECT doc_id, of, unnest(list_transform(range(len(cuts)), lambda k:
    {{'s': CASE WHEN k = 0 THEN 0 ELSE cuts[k] + 1 END, 'e': cuts[k + 1]}})) AS p, lines FROM b),
t AS (
  SELECT doc_id, of, p.s AS s, p.e - p.s + 1 AS n, array_to_string(lines[p.s + 1 : p.e + 1], chr(10)) AS chunk
  FROM c WHERE p.e > p.s),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) AS k FROM t WHERE trim(chunk, chr(10) || chr(9) || chr(13) || ' ') <> ''),
w AS (
  SELECT doc_id, of, i, row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) AS k FROM (
    SELECT doc_id, of, i, lines[i + 1] || chr(10) || lines[i + 2] AS pair FROM (SELECT *, unnest(range(len(lines) - 1)) AS i FROM u))
  WHERE trim(pair, chr(10) || chr(9) || chr(13) || ' ') <> ''),
g AS (
  SELECT doc_id, of, list(DISTINCT i) AS gone FROM (
    SELECT doc_id, of, unnest(range(s, s + n)) AS i FROM r WHERE k > 1 UNION ALL
    SELECT doc_id, of, unnest([i, i + 1]) FROM w WHERE k > 1) GROUP BY 1, 2),
d AS (SELECT doc_id, of, count(*) AS removed_chunks FROM r WHERE k > 1 GROUP BY 1, 2)
SELECT l.doc_id,
  CASE WHEN g.gone IS NULL THEN l.text ELSE array_to_string(list_transform(list_filter(range(len(lines)),
    lambda i: NOT list_contains(g.gone, i)), lambda i: lines[i + 1]), chr(10)) END AS text,
  len(lines)::BIGINT AS n_lines, coalesce(removed_chunks, 0) AS removed_chunks, coalesce(len(g.gone), 0)::BIGINT AS removed_lines
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.of = g.of LEFT JOIN d ON l.doc_id = d.doc_id AND l.of = d.of
"""
