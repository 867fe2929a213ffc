"""Profiles, keys, relationships and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import store
from .ordered import quantiles


def column_profile(df: DataFrame) -> DataFrame:
    """column, dtype, nulls, null_rate, distinct_count, min, max (as text) and mean (numbers) of every column, in one pass."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("dtype"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_distinct(c).alias("distinct_count"),
            F.min(c).cast("string").alias("min"),
            F.max(c).cast("string").alias("max"),
            F.round(F.avg(c).cast("double") if t in numbers or t.startswith("decimal") else F.lit(None).cast("double"), 6).alias("mean"),
            F.count("*").alias("n"),
        )
        for c, t in df.dtypes
    ]
    rows = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return rows.select("column", "dtype", "nulls", F.round(F.try_divide("nulls", "n"), 6).alias("null_rate"), "distinct_count", "min", "max", "mean")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, and how many of them repeat another one."""
    return df.groupBy(F.struct(*df.columns).alias("row")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def candidate_key(df: DataFrame, *key: str) -> DataFrame:
    """rows, unique_combinations, duplicate_rows, null_rows and the verdict on a key."""
    grouped = df.groupBy(*key).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    out = grouped.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("unique_combinations"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_rows"),
    )
    return out.withColumn("is_key", (F.col("duplicate_rows") == 0) & (F.col("null_rows") == 0))


def foreign_key(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Distinct keys on both sides, orphan keys and rows, and null keys."""
    keys = parent.select(F.col(pk).alias("k")).where("k IS NOT NULL").distinct()
    counted = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    orphans = counted.where("k IS NOT NULL").join(keys, "k", "left_anti").agg(
        F.count("*").alias("orphan_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
    )
    own = counted.agg(F.count("k").alias("child_keys"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_rows"))
    return own.crossJoin(keys.agg(F.count("*").alias("parent_keys"))).crossJoin(orphans)


def cardinality(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Children per parent: mean, median, max, share of none and of several; parents without children count."""
    counted = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    out = parent.select(F.col(pk).alias("k")).distinct().join(counted, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.agg(
        F.round(F.avg("n"), 6).alias("mean"),
        F.median("n").alias("median"),
        F.max("n").alias("max"),
        F.round(100.0 * F.count_if(F.col("n") == 0) / F.count("*"), 6).alias("pct_zero"),
        F.round(100.0 * F.count_if(F.col("n") > 1) / F.count("*"), 6).alias("pct_multiple"),
    )


def suspicious(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule and the number of rows that break it, in one pass."""
    parts = [F.struct(F.lit(name).alias("rule"), F.count_if(F.expr(test)).alias("violations")) for name, test in rules.items()]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def date_column(df: DataFrame, column: str) -> DataFrame:
    """parseable, failed and null values of a text column of dates, with the range."""
    ts = F.try_to_timestamp(F.col(column))
    return df.agg(
        F.count(ts).alias("parseable"),
        F.count_if(F.col(column).isNotNull() & ts.isNull()).alias("failed"),
        F.count_if(F.col(column).isNull()).alias("nulls"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
    )


#: Accented letters and what stands for them when names are compared.
ACCENTS = ("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def fold(text):
    """Trimmed, lower-cased and without accents."""
    return F.translate(F.lower(F.trim(text)), *ACCENTS)


def geolocation_profile(geo: DataFrame) -> DataFrame:
    """One row: exact duplicate rows, prefixes of several cities (raw and folded) or wide coordinates, rows per prefix."""
    once = geo.groupBy(*geo.columns).agg(F.count("*").alias("n"))
    wide = lambda c: F.coalesce(F.stddev(c) > 0.1, F.lit(False))
    per = geo.groupBy("prefix").agg(
        F.count("*").alias("n"),
        F.count_distinct("city").alias("cities"),
        F.count_distinct(fold(F.col("city"))).alias("folded"),
        (wide("lat") | wide("lng")).alias("wide"),
    )
    out = per.agg(
        F.count_if(F.col("cities") > 1).alias("multi_city"),
        F.count_if(F.col("folded") > 1).alias("multi_city_folded"),
        F.count_if("wide").alias("wide_spread"),
        F.min("n").alias("min_rows"),
        F.median("n").alias("median_rows"),
        F.max("n").alias("max_rows"),
    )
    return once.agg((F.sum("n") - F.count("*")).alias("duplicate_rows")).crossJoin(out)


def relationships(pairs: dict) -> DataFrame:
    """Matched and unmatched rows of both sides, multiplicity and fan-out risk of each (left, key, right, key)."""
    out = None
    for name, (left, lk, right, rk) in pairs.items():
        a, b = left.groupBy(F.col(lk).alias("k")).agg(F.count("*").alias("l")), right.groupBy(F.col(rk).alias("k")).agg(F.count("*").alias("r"))
        total = lambda x, other, has: F.coalesce(F.sum(F.when(F.col(other).isNotNull() if has else F.col(other).isNull(), F.col(x))), F.lit(0))
        row = a.join(b, "k", "full_outer").agg(
            total("l", "r", True).alias("left_matched"),
            total("l", "r", False).alias("left_unmatched"),
            total("r", "l", True).alias("right_matched"),
            total("r", "l", False).alias("right_unmatched"),
            F.max("l").alias("left_max"),
            F.max("r").alias("right_max"),
        )
        kind = F.when(
            (F.col("left_max") > 1) & (F.col("right_max") > 1),
            "N:M",
        ).when(F.col("left_max") > 1, "N:1").when(F.col("right_max") > 1, "1:N").otherwise("1:1")
        row = row.select(F.lit(name).alias("relationship"), "*", kind.alias("multiplicity"), (F.col("right_max") > 1).alias("fanout_risk"))
        out = row if out is None else out.unionByName(row)
    return out


def sparse_history(facts: dict[str, tuple[DataFrame, str, DataFrame, str]], limits: tuple[int, ...] = (30, 90, 180)) -> DataFrame:
    """For each entity (rows and their key, all entities and their key): how many have rows, how many of these fewer than
    each limit and the share of them, the median number of rows, and how many have none."""
    out = None
    for name, (rows, key, entities, own) in facts.items():
        counted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
        every = entities.select(F.col(own).alias("k")).where("k IS NOT NULL").distinct()
        none = every.join(counted, "k", "left_anti").agg(F.count("*").alias("without_rows"))
        under = [x for v in limits for x in (F.count_if(F.col("n") < v).alias(f"under_{v}"), F.round(F.avg((F.col("n") < v).cast("int")), 6).alias(f"share_under_{v}"))]
        row = counted.agg(F.count("*").alias("entities"), *under, F.median("n").alias("median")).crossJoin(F.broadcast(none)).select(F.lit(name).alias("entity"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def histogram(rows: DataFrame, key: str, clip: int) -> DataFrame:
    """(observations, entities): how many keys have so many rows, those beyond clip counted as clip."""
    each = rows.groupBy(key).agg(F.count("*").alias("n"))
    return each.groupBy(F.least("n", F.lit(clip)).alias("observations")).agg(F.count("*").alias("entities"))


def value_counts(columns: dict[str, tuple[DataFrame, str]], top: int | None = None) -> DataFrame:
    """(column, value, n, share of all rows) of each column, null values as they are; the top ones by n, ties by value."""
    out = None
    for name, (rows, column) in columns.items():
        counted = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        total = counted.agg(F.sum("n").alias("all"))
        part = counted.crossJoin(F.broadcast(total)).select(F.lit(name).alias("column"), "value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
        if top:
            part = part.orderBy(F.desc("n"), "value").limit(top)
        out = part if out is None else out.unionByName(part)
    return out


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, stddev, min, quartiles and max of number columns; the rows are written once, their values sorted."""
    rows = store(df.select(*columns))
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(F.col(c).cast("double")), 6).alias("mean"), F.round(F.stddev(F.col(c).cast("double")), 6).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ) for c in columns
    ]
    each = rows.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    values = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("v")).select("v.*")
    quarters = quantiles(values, "column", "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return each.join(quarters, "column", "left").select("column", "count", "mean", "std", "min", *(F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")), "max")


def repeats_of(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(members, groups): how many groups have so many distinct members."""
    each = rows.groupBy(group).agg(F.count_distinct(member).alias("members"))
    return each.groupBy("members").agg(F.count("*").alias("groups"))


def temporal_coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, grain, period, n): rows of each month and year, and of the whole calendar the days without any (n 0)."""
    out = None
    for name, (rows, column) in tables.items():
        days = rows.where(F.col(column).isNotNull()).groupBy(F.to_date(column).alias("d")).agg(F.count("*").alias("n"))
        spans = [F.struct(F.lit(g).alias("grain"), F.date_format("d", p).alias("period")) for g, p in (("month", "yyyy-MM"), ("year", "yyyy"))]
        counted = days.select("n", F.explode(F.array(*spans)).alias("s")).groupBy("s.grain", "s.period").agg(F.sum("n").alias("n"))
        calendar = days.agg(F.explode(F.sequence(F.min("d"), F.max("d"))).alias("d")).join(days, "d", "left_anti")
        gaps = calendar.select(F.lit("day").alias("grain"), F.date_format("d", "yyyy-MM-dd").alias("period"), F.lit(0).cast("long").alias("n"))
        part = counted.unionByName(gaps).select(F.lit(name).alias("table_name"), "grain", "period", "n")
        out = part if out is None else out.unionByName(part)
    return out
