"""Work on ordered histories of any length: nearest known values, and an automaton folded over each history.

Both range-sort the rows once and store them with the number of their sorted part. A part is folded on its own; what
crosses its borders is one row for each group and part, from which every part learns what came before it. So a group
that holds most of the rows is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import store


def _sorted(rows: DataFrame, columns: list[str | Column]) -> DataFrame:
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("part", F.spark_partition_id())


def sorted_parts(rows: DataFrame, columns: list[str | Column]) -> DataFrame:
    """rows, sorted by columns over all parts and written, with the number of their part."""
    return store(_sorted(rows, columns))


def numbered(rows: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """rows with name, their place in their group by order, from 1: a part numbers its own rows and adds those before it."""
    parts = store(_sorted(rows, [group, *order]).withColumn("_at", F.monotonically_increasing_id()))
    ends = parts.groupBy(group, "part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("part")) - F.col("_n")  # one row for each part
    ends = store(ends.select(group, "part", "_first", earlier.alias("_before")))
    placed = parts.alias("p").join(ends.alias("e"), F.col(f"p.{group}").eqNullSafe(F.col(f"e.{group}")) & (F.col("p.part") == F.col("e.part")))
    return placed.select(*(F.col(f"p.{c}").alias(c) for c in rows.columns), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each of shares): exact quantiles of each group's values, linear between neighbours, without nulls.

    Equal values are counted first, so that a frequent one is a row; the distinct ones are range-sorted, and only the
    parts that hold a place asked for are gone through. No task holds all values of a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    parts = sorted_parts(counted, [group, value])
    sums = parts.groupBy(group, "part").agg(F.sum("_n").alias("_n"))
    of_group = Window.partitionBy(group)  # a row for each sorted part
    sums = store(sums.select(group, "part", "_n", (F.sum("_n").over(of_group.orderBy("part")) - F.col("_n")).alias("_before"), F.sum("_n").over(of_group).alias("_all")))
    place = {name: share * (F.col("_all") - 1) for name, share in shares.items()}
    ends = [end for p in place.values() for end in (F.floor(p), F.ceil(p))]
    inside = lambda end: (F.col("_before") <= end) & (end < F.col("_before") + F.col("_n"))
    asked = reduce(or_, map(inside, ends))
    held = sums.where(asked).select(F.col(group).alias("_g"), F.col("part").alias("_part"), F.col("_before").alias("_start"), "_all")
    near = parts.join(F.broadcast(held), F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))  # a row or two for each place
    here = Window.partitionBy(group, "part").orderBy(value)
    near = near.withColumn("_before", F.col("_start") + F.sum("_n").over(here) - F.col("_n")).where(asked)
    at = lambda end: F.max(F.when(inside(end), F.col(value)))
    both = near.groupBy(group, "_all").agg(*(at(f(p)).alias(f"{name}_{i}") for name, p in place.items() for i, f in enumerate((F.floor, F.ceil))))
    between = lambda name, p: F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * (p - F.floor(p))
    return both.select(group, *(between(name, p).alias(name) for name, p in place.items()))


def nearest_known(points: DataFrame, known: DataFrame, group: str, value: str) -> DataFrame:
    """points with below and above: the largest known value (group, known) up to theirs and the smallest one from theirs on.

    Null groups and values have no neighbours. Where a known value equals a point's, below is that value.
    """
    names = points.columns
    marks = known.select(F.col(group).alias("_g"), F.col("known").alias("_v"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), F.lit(None).alias("_row")).where("_v IS NOT NULL").distinct()
    own = points.select(F.col(group).alias("_g"), F.col(value).alias("_v"), F.lit(1).alias("_kind"), F.xxhash64(*names).alias("_tie"), F.struct(*names).alias("_row"))
    parts = sorted_parts(own.unionByName(marks), ["_g", "_v", "_kind", "_tie"])
    mark = F.when(F.col("_kind") == 0, F.col("_v"))
    edges = parts.groupBy("_g", "part").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    by = Window.partitionBy("_g").orderBy("part")  # one row for each sorted part
    edges = store(edges.select("_g", "part", F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("low").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("after")))
    here = Window.partitionBy("_g", "part").orderBy("_v", "_kind")
    out = parts.withColumn("below", F.last(mark, True).over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.first(mark, True).over(here.rowsBetween(0, Window.unboundedFollowing)))
    out = out.where("_kind = 1").alias("o").join(edges.alias("e"), F.col("o._g").eqNullSafe(F.col("e._g")) & (F.col("o.part") == F.col("e.part")), "left")
    none = F.col("_v").isNull() | F.col("o._g").isNull()
    below, above = F.coalesce("below", "before"), F.coalesce("above", "after")
    return out.select("_row.*", F.when(~none, below).alias("below"), F.when(~none, above).alias("above"))


def match_values(numbers: DataFrame, known: DataFrame, tolerance: float = 0.0005, floor: float = 0.01) -> DataFrame:
    """numbers (value, unit and others) with matched and nearest, against all known values (unit, known) of their unit.

    A known value v matches c if |c - v| <= max(tolerance * |v|, floor). As that bound grows slower than the distance,
    only the two neighbours of c can be the first to match: a range join without comparing ranges. Of two values equally
    near the smaller one is the nearest.
    """
    near = nearest_known(numbers, known, "unit", "value")
    gap = {c: F.abs(F.col("value") - F.col(c)) for c in ("below", "above")}
    fits = [F.coalesce(g <= F.greatest(tolerance * F.abs(F.col(c)), F.lit(floor)), F.lit(False)) for c, g in gap.items()]
    nearest = F.when(F.col("above").isNull() | (gap["below"] <= gap["above"]), F.col("below")).otherwise(F.col("above"))
    return near.withColumn("matched", fits[0] | fits[1]).withColumn("nearest", nearest).drop("below", "above")


def run_automaton(rows: DataFrame, key: str, order: list[str], symbol: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """rows with before, legal and after: the state of key's automaton before and after each row, in order.

    moves: (state, symbol) to the next state; a symbol without a move from the state is illegal and changes nothing. A
    part is run from every state at once, as it is not known yet where it starts; its effect is a map of states, and the
    maps of a key's parts, one after another, tell where each part starts.
    """
    states = sorted({start} | {s for s, _ in moves} | set(moves.values()))
    number = {s: i for i, s in enumerate(states)}
    names = rows.columns
    step = {x: [number[moves.get((s, x), s)] for s in states] for x in {x for _, x in moves}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = object(), list(range(len(states)))
        for batch in batches:
            out = []
            for k, x in zip(batch.column(key).to_pylist(), batch.column(symbol).to_pylist(), strict=True):
                if k != last:
                    last, now = k, list(range(len(states)))
                out.append(now)
                if x in step:
                    move = step[x]
                    now = [move[s] for s in now]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "from_each"])

    shape = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    # in the stage that sorts: a file that is read again may be split, or share a task with others
    ran = store(_sorted(rows, [key, *order]).mapInArrow(run, f"{shape}, part int, from_each array<int>"))
    place = F.struct(*order)
    ends = ran.groupBy(key, "part").agg(F.max_by("from_each", place).alias("m"), F.max_by(symbol, place).alias("x"))
    table = F.create_map(*[y for x, move in step.items() for y in (F.lit(x), F.array(*map(F.lit, move)))])
    move = F.coalesce(table[F.col("x")], F.array(*map(F.lit, range(len(states)))))
    effect = F.transform("m", lambda s: F.element_at(move, s + 1))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    entry = F.aggregate(F.collect_list("effect").over(earlier), F.lit(number[start]), lambda s, m: F.element_at(m, s + 1))
    ends = store(ends.select(key, "part", effect.alias("effect")).select(key, "part", entry.alias("entry")))
    joined = ran.alias("r").join(ends.alias("e"), F.col(f"r.{key}").eqNullSafe(F.col(f"e.{key}")) & (F.col("r.part") == F.col("e.part")))
    names_of = F.array(*map(F.lit, states))
    before = F.element_at("from_each", F.col("entry") + 1)
    after = F.element_at(F.coalesce(table[F.col(f"r.{symbol}")], F.array(*map(F.lit, range(len(states))))), before + 1)
    legal = F.coalesce(F.array_contains(F.array(*[F.concat_ws("\x00", F.lit(s), F.lit(x)) for s, x in moves]), F.concat_ws("\x00", F.element_at(names_of, before + 1), F.col(f"r.{symbol}"))), F.lit(False))
    return joined.select(*(F.col(f"r.{n}").alias(n) for n in names), F.element_at(names_of, before + 1).alias("before"), legal.alias("legal"), F.element_at(names_of, after + 1).alias("after"))
