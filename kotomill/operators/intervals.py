"""Joins of spans and ranges that lie in separate tables: the first range that contains a span, spans without any, and all pairs.

A range of length l is filed at the level of the smallest power of two that l does not exceed, in the one or two stretches of that length that it
touches. A span asks at every level that occurs (for ranges that contain it: at those not below its own) for the one stretch where it starts, so an equi-join on (key, level, stretch) finds every range
that holds its start. Ranges that begin inside a span are found the other way round, with the spans filed. No task gets a document: its
stretches are spread, however many ranges it has, and rows meet only where they are near. Equal spans and equal ranges of a key are joined once.
``outside`` needs no pairs and joins nothing: it takes a running maximum in blocks of places.

Ranges are half open. Defined edge cases: a null key is a key of its own; spans and ranges with a null or an end not behind the start match nothing,
and such spans stay in outer and anti joins; repeated spans each keep their row; empty tables are empty sides. Columns of the ranges come in
one struct, so that none can clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTAINED, OVERLAPPING = "contained", "overlapping"
#: A block of ``outside`` is 2^BLOCK places.
BLOCK = 12


def _level() -> Column:
    return F.ceil(F.log2((F.col("e") - F.col("s")).cast("double"))).cast("int")


def _filed(rows: DataFrame) -> DataFrame:
    """Rows with k, s, e, filed at their level and stretches."""
    width = F.expr("shiftleft(1L, level)")
    return rows.withColumn("level", _level()).withColumn("stretch", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))))


def _asking(rows: DataFrame, levels: list[int], least: Column | None = None) -> DataFrame:
    """Rows with k, s, e, for each level from ``least`` on with the stretch of their start."""
    asked = F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("s") / (1 << n)).alias("stretch")) for n in levels)) if levels else F.array().cast("array<struct<level:int,stretch:bigint>>")
    every = rows.withColumn("asked", F.explode(asked)).select(*rows.columns, "asked.level", "asked.stretch")
    return every if least is None else every.where(F.col("level") >= least)


def _met(filed: DataFrame, asking: DataFrame) -> DataFrame:
    """Pairs of filed and asking rows of one key where the asking row starts inside the filed one, as structs f and a."""
    pack = lambda rows, name: rows.select("k", "level", "stretch", F.struct(*(c for c in rows.columns if c not in ("level", "stretch"))).alias(name))
    a, f = pack(asking, "a").alias("x"), pack(filed, "f").alias("y")
    same = F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.stretch") == F.col("y.stretch"))
    # a row is filed in two stretches, but only one of them holds the start that asks; files of ranges are far smaller than their rows, so no side is broadcast by its files' size
    return a.join(f.hint("merge"), same).select("a", "f").where((F.col("a.s") >= F.col("f.s")) & (F.col("a.s") < F.col("f.e")))


def _levels(filed: DataFrame) -> list[int]:
    return sorted(r.level for r in filed.select("level").distinct().collect())  # at most 63


def _sound(rows: DataFrame, key: str, start: str, end: str, *more: Column) -> DataFrame:
    return rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"), *more).where("s < e")


def pairs(spans: DataFrame, ranges: DataFrame, how: str, key: str = "doc_id", start: str = "start", end: str = "end") -> DataFrame:
    """(k, s, e, range): each different span with each range of its key that it is contained in or overlaps; range holds the range's columns."""
    own = _sound(spans, key, start, end).distinct()
    others = _sound(ranges, key, start, end, F.struct(*(F.col(f"`{c}`") for c in ranges.columns)).alias("r"))
    filed = _filed(others)
    # a range that contains a span is no shorter, so its level is not below the span's
    found = _met(filed, _asking(own, _levels(filed), _level() if how == CONTAINED else None)).select("a.k", "a.s", "a.e", F.col("f.e").alias("re"), F.col("f.r").alias("range"))
    if how == CONTAINED:
        return found.where("e <= re").drop("re")
    spread = _filed(own)
    inside = _met(spread, _asking(others, _levels(spread))).where(F.col("a.s") > F.col("f.s")).select("f.k", "f.s", "f.e", F.col("a.r").alias("range"))
    return found.drop("re").unionByName(inside)


def _joined(spans: DataFrame, found: DataFrame, how: str, key: str, start: str, end: str, *more: str) -> DataFrame:
    at = [("k", key), ("s", start), ("e", end)]
    same = reduce(lambda x, y: x & y, (F.col(f"_found.{a}").eqNullSafe(F.col(f"_spans.`{b}`")) for a, b in at))
    return spans.alias("_spans").join(found.alias("_found").hint("merge"), same, how).select(*(F.col(f"_spans.`{c}`") for c in spans.columns), *(F.col(f"_found.{c}") for c in more))


def first_containing(spans: DataFrame, ranges: DataFrame, order: str, key: str = "doc_id", start: str = "start", end: str = "end", into: str = "range") -> DataFrame:
    """All spans with the column ``into``: of the ranges that contain the span the one that is first by ``order`` (then by start and end), null if there is none."""
    first = pairs(spans, ranges, CONTAINED, key, start, end).groupBy("k", "s", "e").agg(F.min_by("range", F.struct(f"range.{order}", f"range.{start}", f"range.{end}")).alias(into))
    return _joined(spans, first, "left", key, start, end, into)


def outside(spans: DataFrame, ranges: DataFrame, how: str = OVERLAPPING, key: str = "doc_id", start: str = "start", end: str = "end") -> DataFrame:
    """The spans that no range of their key contains or overlaps, columns unchanged.

    Whether there is one shows in how far the ranges reach that begin early enough: at the span's start at the latest to contain it, before its end
    to overlap it. So every row is shuffled once, whatever the ranges' lengths: to its block of places, where a running maximum is taken in order.
    How far the ranges of earlier blocks reach comes from one row a block.
    """
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    sound = s < e
    at = s if how == CONTAINED else e
    # ranges that begin at the place itself count for a span's start, not for its end
    turn = 2 if how == CONTAINED else 1
    row = F.struct(*(F.col(f"`{c}`") for c in spans.columns))
    own = spans.select(F.col(f"`{key}`").alias("k"), F.when(sound, at).alias("at"), F.lit(turn).alias("turn"), F.lit(None).cast("long").alias("reach"), F.when(sound, e if how == CONTAINED else s + 1).alias("least"), row.alias("row"))
    others = _sound(ranges, key, start, end).select("k", F.col("s").alias("at"), F.lit(3 - turn).alias("turn"), F.col("e").alias("reach"))
    block = F.shiftright("at", BLOCK)
    blocks = own.where("at is not null").select("k", "at", "reach").unionByName(others.select("k", "at", "reach")).groupBy("k", block.alias("block")).agg(F.max("reach").alias("reach"))
    before = F.max("reach").over(W.partitionBy("k").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    carried = blocks.select("k", F.shiftleft("block", BLOCK).alias("at"), F.lit(0).alias("turn"), before.alias("reach")).where("reach is not null")
    every = own.unionByName(others.unionByName(carried), allowMissingColumns=True)
    reached = F.max("reach").over(W.partitionBy("k", block).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = every.select("row", "least", reached.alias("reached")).where("row is not null and not coalesce(reached >= least, false)")
    return kept.select(*(F.col("row")[c].alias(c) for c in spans.columns))
