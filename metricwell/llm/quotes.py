"""Chat formatting by quotation linking, with DataFrame functions only.

Lines beginning with ">" are quoted, once for each ">". A quoted passage is a run of lines of one level. It is
normalised (lower case, single spaces), hashed, and looked up among the earlier messages of its conversation: among
their runs of unquoted lines, their whole unquoted texts, and their single lines; where the passage as a whole is not
found, its first line decides. A message replies to the latest message that its outermost linked quotation comes from.
Messages linked in this way are a thread, named by the turn of its first message, and a conversation in reply order is
sorted by thread and turn: a reply never stands before what it replies to, and a thread stays together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

_MARK = r"^(?:[ \t]?>)+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _hash(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with lines (level, body), own (the unquoted text) and runs (level, bodies)."""
    mark = lambda x: F.regexp_extract(x, _MARK, 0)
    line = lambda x: F.struct((F.length(mark(x)) - F.length(F.replace(mark(x), F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, _MARK, "").alias("body"))
    out = messages.withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    out = out.withColumn("starts", starts)
    run = lambda s, k: F.struct(F.get("lines", s)["level"].alias("level"), F.transform(F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s), lambda x: x["body"]).alias("bodies"))
    out = out.withColumn("runs", F.transform("starts", run))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"])
    return out.withColumn("own", F.array_join(own, "\n")).drop("starts")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes, trimmed), quotes, linked, reply_to and thread of each message.

    quotes counts the quoted passages, linked those found in an earlier turn of the conversation; reply_to is null and
    thread the own turn without such a link. A null text counts as empty; messages without conv_id or turn are kept,
    their quotations neither counted nor linked. Of equal passages the latest earlier turn counts. Repeated rows get equal results. An empty
    table gives an empty result. Other columns are ignored. Rows come sorted by conv_id, thread and turn.
    """
    key = ["conv_id", "turn", "of"]
    rows = messages.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("of"))
    read = parsed(rows)
    said = F.array_distinct(
        F.concat(
            F.array(_hash(F.col("own"))),
            F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: _hash(F.array_join(r["bodies"], "\n"))),
            F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: _hash(x["body"])),
        )
    )
    said = F.array_remove(said, _hash(F.lit("")))  # a blank line is nobody's words
    passages = F.filter(
        F.transform(
            "runs",
            lambda r, i: F.struct(
                i.alias("i"),
                r["level"].alias("level"),
                _hash(F.array_join(r["bodies"], "\n")).alias("whole"),
                _hash(F.element_at(r["bodies"], 1)).alias("line"),
                (normalised(F.array_join(r["bodies"], " ")) != "").alias("full"),
            ),
        ),
        lambda p: (p["level"] > 0) & p["full"],
    )
    quoting = read.where(F.col("text").rlike(r"(?m)^[ \t]?>") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = materialize(quoting.select(*key, F.explode(passages).alias("p")).select(*key, "p.*").distinct())
    asked = quoted.select("conv_id", "turn", F.explode(F.array("whole", "line")).alias("code")).distinct()
    convs = quoted.select("conv_id").distinct()
    original = read.join(convs, "conv_id", "left_semi").select("conv_id", "turn", F.explode(said).alias("code")).distinct()
    original = original.join(asked.select("conv_id", "code").distinct(), ["conv_id", "code"], "left_semi")
    # as of its own turn, the latest earlier turn that said the same
    line = Window.partitionBy("conv_id", "code").orderBy("turn", "ask").rowsBetween(Window.unboundedPreceding, -1)
    both = asked.withColumn("ask", F.lit(0)).unionByName(original.withColumn("ask", F.lit(1)))
    found = both.withColumn(
        "source",
        F.last(F.when(F.col("ask") == 1, F.col("turn")), ignorenulls=True).over(line),
    ).where("ask = 0 AND source IS NOT NULL").select("conv_id", "turn", "code", "source")
    whole = found.select("conv_id", "turn", F.col("code").alias("whole"), F.col("source").alias("a"))
    first = found.select("conv_id", "turn", F.col("code").alias("line"), F.col("source").alias("b"))
    linked = quoted.join(
        whole,
        ["conv_id", "turn", "whole"],
        "left",
    ).join(first, ["conv_id", "turn", "line"], "left").withColumn("source", F.coalesce("a", "b"))
    told = linked.groupBy(*key).agg(
        F.count("*").alias("quotes"),
        F.count("source").alias("linked"),
        F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("up"), "source")))["source"].alias("reply_to"),
    )
    told = materialize(told)

    # thread: follow reply_to to its end, each round twice as far
    jump = told.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread"))
    while True:
        jump = materialize(jump)
        ahead = jump.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        if jump.join(ahead, ["conv_id", "thread"], "left_semi").isEmpty():
            break
        jump = jump.join(ahead, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"))
    out = read.select(*key, "role", F.trim("own").alias("text")).join(told, key, "left").join(jump, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.coalesce("quotes", F.lit(0)).cast("long").alias("quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
    )
    return out.orderBy("conv_id", "thread", "turn")


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


_NORM = r"trim(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'))"
OP7_SQL = rf"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM conversations),
ln AS (
  SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(raw[i], '^(?:[ \t]?>)+'), '[^>]', '', 'g')) AS level, regexp_replace(raw[i], '^(?:[ \t]?>)+', '') AS body
  FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM m)),
st AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS s FROM ln),
rn AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY i) AS r FROM st),
run AS (
  SELECT id, conv_id, turn, r, any_value(level) AS level, {_NORM.format("string_agg(body, chr(10) ORDER BY i)")} AS whole, {_NORM.format("first(body ORDER BY i)")} AS line
  FROM rn GROUP BY id, conv_id, turn, r),
own AS (SELECT id, string_agg(body, chr(10) ORDER BY i) AS text FROM ln WHERE level = 0 GROUP BY id),
said AS (
  SELECT conv_id, turn, whole AS code FROM run WHERE level = 0 UNION
  SELECT conv_id, turn, {_NORM.format("body")} FROM ln WHERE level = 0 UNION
  SELECT m.conv_id, m.turn, {_NORM.format("own.text")} FROM own JOIN m USING (id)),
words AS (SELECT * FROM said WHERE code <> ''),
q AS (SELECT * FROM run WHERE level > 0 AND whole <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
lk AS (
  SELECT q.*, coalesce((SELECT max(turn) FROM words WHERE words.conv_id = q.conv_id AND words.turn < q.turn AND code = q.whole),
    (SELECT max(turn) FROM words WHERE words.conv_id = q.conv_id AND words.turn < q.turn AND code = q.line)) AS source FROM q),
t AS (
  SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, count(*) AS quotes, count(source) AS linked,
    first(source ORDER BY source IS NULL, level, source DESC) AS reply_to FROM lk GROUP BY id),
up AS (SELECT conv_id, turn, max(reply_to) AS reply_to FROM t WHERE reply_to IS NOT NULL GROUP BY 1, 2),
th AS (
  SELECT conv_id, turn, reply_to AS thread FROM up UNION ALL
  SELECT th.conv_id, th.turn, up.reply_to FROM th JOIN up ON up.conv_id = th.conv_id AND up.turn = th.thread),
root AS (SELECT conv_id, turn, min(thread) AS thread FROM th GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, trim(coalesce(own.text, '')) AS text, coalesce(t.quotes, 0) AS quotes, coalesce(t.linked, 0) AS linked,
  t.reply_to, coalesce(root.thread, m.turn) AS thread
FROM m LEFT JOIN own ON own.id = m.id LEFT JOIN t ON t.id = m.id LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
