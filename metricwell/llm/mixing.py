"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Documents are leaves' rows in a tree domain - language - source. The token budget goes down the tree: the children of
a node share its budget by weight; a child that cannot use its share (all its tokens in all allowed epochs) gets what
it can use, and its siblings share the rest by weight again, so a shortage leaves a node only when all its children are
full. Each leaf then takes its budget from its seeded epochs: an epoch is the leaf's documents in the order of
md5(seed|epoch|doc_id); whole epochs come first, then a prefix of the next one.

Only sums per leaf and per (leaf, bucket of the order) are windowed. The position inside an order is worked out for the
one bucket in which a leaf's budget ends, a 4096th of its rows, so a hot leaf is never sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

SEED, EPOCHS = 17, 2
#: Weights of the tree's nodes; a node that is not named weighs 1.
DOMAIN_WEIGHTS = {"domain0": 5, "domain1": 3, "domain2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
_LEAF = ["_mix_domain", "_mix_lang", "_mix_source"]
_DIGITS = 3


def domain_of(source: Column) -> Column:
    """The domain of a source where the data name none: one of three, by the source's hash."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 4), 16, 10).cast("long") % 3).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with their part of the parent's budget: columns cap, w and budget (the parent's) in, budget (own) out."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    group = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = children.withColumn("full", F.col("cap") * rest <= F.col("w") * (F.col("budget") - before))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
    own = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * (budget - used)) div open"))
    return full.withColumn("used", used).withColumn("open", open_).withColumn("budget", own).drop("full", "used", "open")


def budgets(leaves: DataFrame, epochs: int = EPOCHS, share: float = 1.0, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """The tree's leaves with tokens and budget. leaves: _LEAF and tokens, one row for each; share: of all tokens."""
    level = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * epochs)
    domain = level.groupBy(_LEAF[0]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    every = Window.partitionBy(F.lit(1))
    domain = domain.withColumn("budget", F.least(F.floor(F.sum("tokens").over(every) * F.lit(share)).cast("long"), F.sum("cap").over(every)))
    domain = share_out(domain.drop("tokens").withColumn("w", _weight(_LEAF[0], weights[0])), [], _LEAF[0])
    lang = level.groupBy(*_LEAF[:2]).agg(F.sum("cap").alias("cap")).join(domain.select(_LEAF[0], "budget"), _LEAF[0])
    lang = share_out(lang.withColumn("w", _weight(_LEAF[1], weights[1])), _LEAF[:1], _LEAF[1])
    leaf = level.join(lang.select(*_LEAF[:2], "budget"), _LEAF[:2])
    leaf = share_out(leaf.withColumn("w", _weight(_LEAF[2], weights[2])), _LEAF[:2], _LEAF[2])
    return leaf.select(*_LEAF, "tokens", "budget")


def mix(docs: DataFrame, epochs: int = EPOCHS, share: float = 1.0, seed: int = SEED, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), domain: Column | None = None) -> DataFrame:
    """doc (a struct of all columns of docs), domain, lang, source, tokens, epoch and taken.

    One row for each document and epoch that a leaf takes it in; taken is the tokens taken, less than tokens only for
    the document in which a leaf's prefix ends. A null lang or source is a node named "". Null texts and texts
    without tokens are never taken. Orders tie by doc_id, then by the number of tokens; repeated rows are taken one by
    one. A division by weights rounds down, so up to a token for each child stays unused. An empty table gives an empty
    result.
    """
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    domain = domain_of(source) if domain is None else domain
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").alias("_mix_id"),
        domain.alias(_LEAF[0]),
        lang.alias(_LEAF[1]),
        source.alias(_LEAF[2]),
        tokens_of(F.col("text")).alias("_mix_tokens"),
    )
    slim = materialize(rows.select(*_LEAF, "_mix_tokens", "_mix_id"))
    leaf = materialize(budgets(slim.groupBy(*_LEAF).agg(F.sum("_mix_tokens").alias("tokens")), epochs, share, weights))
    plan = leaf.select(*_LEAF, F.expr("budget div tokens").alias("_mix_whole"), (F.col("budget") % F.col("tokens")).alias("_mix_rest"))
    key = lambda who: F.md5(F.concat_ws("|", F.lit(seed), "_mix_whole", F.coalesce(F.col(who).cast("string"), F.lit(""))).cast("binary"))
    bucket = F.substring("_mix_key", 1, _DIGITS)
    sums = slim.where("_mix_tokens > 0").join(plan, _LEAF).withColumn("_mix_key", key("_mix_id")).groupBy(*_LEAF, bucket.alias("_mix_bucket")).agg(
        F.sum("_mix_tokens").alias("n"),
        F.first("_mix_rest").alias("_mix_rest"),
    )
    before = Window.partitionBy(*_LEAF).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    border = sums.withColumn(
        "_mix_before",
        F.coalesce(F.sum("n").over(before), F.lit(0)),
    ).where("_mix_before <= _mix_rest AND _mix_rest < _mix_before + n")
    plan = materialize(plan.join(border.select(*_LEAF, F.col("_mix_bucket").alias("_mix_border"), "_mix_before"), _LEAF, "left"))

    on = rows.where("_mix_tokens > 0").join(plan, _LEAF).withColumn("_mix_key", key("_mix_id")).withColumn("_mix_bucket", bucket)
    inner = Window.partitionBy(*_LEAF).orderBy("_mix_key", "_mix_id", "_mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = on.where("_mix_bucket = _mix_border").withColumn(
        "_mix_start",
        F.col("_mix_before") + F.coalesce(F.sum("_mix_tokens").over(inner), F.lit(0)),
    )
    last = last.withColumn(
        "_mix_part",
        F.greatest(F.lit(0).cast("long"), F.least("_mix_tokens", F.col("_mix_rest") - F.col("_mix_start"))),
    ).drop("_mix_start")
    rest = on.where("_mix_bucket <> _mix_border").withColumn(
        "_mix_part",
        F.when(F.col("_mix_bucket") < F.col("_mix_border"), F.col("_mix_tokens")).otherwise(F.lit(0).cast("long")),
    )
    some = last.unionByName(rest)
    times = F.col("_mix_whole") + F.when(F.col("_mix_part") > 0, 1).otherwise(0)
    taken = some.where(times > 0).withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    taken = taken.withColumn("_mix_taken", F.when(F.col("_mix_epoch") < F.col("_mix_whole"), F.col("_mix_tokens")).otherwise(F.col("_mix_part")))
    return taken.select("doc", *[F.col(f"_mix_{c}").alias(c) for c in ("domain", "lang", "source", "tokens", "epoch", "taken")])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return taken.select("doc.doc_id", "domain", "lang", "source", "tokens", "epoch", "taken")


def _sql_weight(column: str, weights: dict[str, int]) -> str:
    return f"(CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END)" if weights else "1"


def _sql_share(name: str, source: str, parent: str, own: str) -> str:
    return f"""
{name}0 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({source})),
{name}1 AS (SELECT *, cap * rest <= w * (b - before) AS isfull FROM {name}0),
{name} AS (SELECT * EXCLUDE (b, before, rest, isfull), CASE WHEN isfull THEN cap ELSE (w * (b - coalesce(sum(CASE WHEN isfull THEN cap END) OVER (PARTITION BY {parent}), 0)))
    // sum(CASE WHEN NOT isfull THEN w END) OVER (PARTITION BY {parent}) END AS b FROM {name}1)"""


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT % 3) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
f AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, {EPOCHS} * sum(tokens)::BIGINT AS cap FROM d GROUP BY ALL HAVING sum(tokens) > 0),
{_sql_share("a", f"SELECT domain, sum(cap)::HUGEINT AS cap, {_sql_weight('domain', DOMAIN_WEIGHTS)} AS w, least(sum(sum(tokens)) OVER (), sum(sum(cap)) OVER ()) AS b FROM f GROUP BY domain", "1", "domain").strip()},
{_sql_share("l", f"SELECT f.domain, lang, sum(f.cap)::HUGEINT AS cap, {_sql_weight('lang', LANG_WEIGHTS)} AS w, any_value(a.b) AS b FROM f JOIN a USING (domain) GROUP BY f.domain, lang", "domain", "lang").strip()},
{_sql_share("s", f"SELECT f.domain, f.lang, f.source, tokens, f.cap::HUGEINT AS cap, {_sql_weight('source', SOURCE_WEIGHTS)} AS w, l.b FROM f JOIN l USING (domain, lang)", "domain, lang", "source").strip()},
p AS (SELECT domain, lang, source, (b // tokens)::BIGINT AS whole, (b % tokens)::BIGINT AS rest FROM s),
o AS (
  SELECT d.*, whole, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}|' || whole || '|' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN p USING (domain, lang, source) WHERE tokens > 0),
q AS (SELECT *, greatest(0, least(tokens, rest - start)) AS part FROM o),
e AS (SELECT *, unnest(range(whole + CASE WHEN part > 0 THEN 1 ELSE 0 END)) AS epoch FROM q)
SELECT doc_id, domain, lang, source, tokens, epoch, CASE WHEN epoch < whole THEN tokens ELSE part END AS taken FROM e
"""
