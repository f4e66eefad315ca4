"""Points in intervals by dyadic blocks: equal keys, so a join's rows grow with its input and not with points times intervals.

A half-open interval of integers is cut into at most two blocks a level (the numbers k * 2^level to (k + 1) * 2^level - 1); a
point lies in one block of each level. Blocks of one path are keys of their own, so a path
with very many intervals is spread. What many intervals say about a block is reduced to one row before the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored

#: Where intervals without an end stop; points must be smaller.
NO_END = 1 << 40
_LEVELS = 41


def _top(a: Column, b: Column) -> Column:
    """The last level of which a block may fit into [a, b): one as long as the interval."""
    return F.when(a < b, F.least(F.length(F.bin(b - a)) - 1, F.lit(_LEVELS - 1))).otherwise(0)


def blocks(first: Column, end: Column) -> Column:
    """The blocks (level, block) that make up [first, end), for first from 0; null ends run on."""
    a, b = first.cast("long"), F.coalesce(end.cast("long"), F.lit(NO_END))

    def of_level(level: Column) -> Column:
        whole = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.call_function("shiftright", a + whole - 1, level), F.call_function("shiftright", b, level)
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block")))
        return F.array(left, right)

    both = F.flatten(F.transform(F.sequence(F.lit(0), _top(a, b)), of_level))
    return F.array_distinct(F.array_compact(both))


def cut(intervals: DataFrame, first: str = "first", end: str = "end") -> DataFrame:
    """``intervals`` once for each of their blocks: with ``level`` and ``block``; empty ones are left out."""
    a, b = F.col(first).cast("long"), F.coalesce(F.col(end).cast("long"), F.lit(NO_END))
    found = intervals.where(a < b)
    # rows of one level each, not one array: plain columns are compiled, functions over arrays are not
    each = found.select("*", F.explode(F.sequence(F.lit(0), _top(a, b))).alias("level"))
    low = F.call_function("shiftright", a + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1, F.col("level"))
    fits = each.select("*", low.alias("__low"), F.call_function("shiftright", b, F.col("level")).alias("__high")).where("__low < __high and (__low % 2 = 1 or __high % 2 = 1)")
    odd = F.array(F.when(F.col("__low") % 2 == 1, F.col("__low")), F.when(F.col("__high") % 2 == 1, F.col("__high") - 1))
    return fits.select(*intervals.columns, "level", F.explode(odd).alias("block")).where("block is not null")


def _looked_up(points: DataFrame, known: DataFrame, point: str) -> DataFrame:
    """``points`` once for each level that ``known`` has (at most 41), with level and block."""
    levels = sorted(r.level for r in known.select("level").distinct().collect())
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.shiftright(F.col(point).cast("long"), v).alias("block")) for v in levels)) if levels else F.array().cast("array<struct<level:int,block:bigint>>"))
    return points.withColumn("__b", each).select(*points.columns, "__b.level", "__b.block")


def best_at(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, order: Column, value: Column, name: str) -> DataFrame:
    """``points`` (keys, point, more) with ``name``: ``value`` of the interval (keys, first, end, more) that holds the point and has the least ``order``; null if none does.

    Rows of equal keys and point are looked up once.
    """
    pieces = cut(intervals.select(*keys, "first", "end", F.struct(order.alias("o"), value.alias("v")).alias("__x")))
    known = stored(pieces.groupBy(*keys, "level", "block").agg(F.min("__x").alias("__x")), "blocks")
    at = _looked_up(points.select(*keys, point).distinct(), known, point)
    found = at.join(known.hint("merge"), [*keys, "level", "block"]).groupBy(*keys, point).agg(F.min("__x")["v"].alias(name))
    return points.join(found, [*keys, point], "left")


#: Bits of a place within its stretch.
_STRETCH = 16


def _held(points: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The points (keys, __g, __at, __row) that a span (keys, __g, __at, __end) holds or not: with ``__in``. One pass in order of places: a point is held if an earlier span ends behind it."""
    both = points.withColumn("__end", F.lit(None).cast("long")).unionByName(spans, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "__g").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__in", F.coalesce(F.max("__end").over(by) > F.col("__at"), F.lit(False))).where("__row is not null").drop("__end")


def outside(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str) -> DataFrame:
    """The points that no interval of their keys holds; those without a point always stay.

    The places of a key are cut into stretches of 2^16. An interval is at most two pieces, in its first and its last stretch, and a range of whole stretches between. Whole stretches
    are looked at first; those that are held become pieces. So a point crosses one shuffle, whatever the lengths, and a key with very many places is spread.
    """
    at = F.col(point).cast("long")
    a, b = F.col("first").cast("long"), F.coalesce(F.col("end").cast("long"), F.lit(NO_END))
    low, high = F.shiftright(a + (1 << _STRETCH) - 1, _STRETCH), F.shiftright(b, _STRETCH)
    found = intervals.select(*keys, a.alias("a"), b.alias("b"), low.alias("low"), high.alias("high")).where("a < b").na.drop(subset=list(keys))
    wide = found.where("low < high").groupBy(*keys, F.lit(0).cast("long").alias("__g"), F.col("low").alias("__at")).agg(F.max("high").alias("__end"))
    seen = points.where(at.isNotNull()).select(*keys, F.lit(0).cast("long").alias("__g"), F.shiftright(at, _STRETCH).alias("__at"), F.lit(True).alias("__row")).distinct()
    start = lambda c: F.shiftleft(F.col(c), _STRETCH)
    whole = _held(seen, wide, keys).where("__in").select(*keys, F.col("__at").alias("__g"), start("__at").alias("__at"), (start("__at") + (1 << _STRETCH)).alias("__end"))
    ends = F.array(F.struct(F.col("a").alias("__at"), F.least("b", start("low")).alias("__end")), F.struct(F.greatest("a", start("high")).alias("__at"), F.col("b").alias("__end")))
    pieces = found.select(*keys, F.inline(ends)).where("__at < __end").withColumn("__g", F.shiftright("__at", _STRETCH))
    row = F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("__row")
    placed = points.select(*keys, F.shiftright(at, _STRETCH).alias("__g"), at.alias("__at"), row)
    return _held(placed, whole.unionByName(pieces), keys).where("not __in").select(*(F.col(f"__row.`{c}`").alias(c) for c in points.columns))


def holding(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str) -> DataFrame:
    """Every pair of a point and an interval that holds it, once: the columns of both; each pair meets in one block only."""
    pieces = cut(intervals)
    # merged: Spark takes the exploded side for as small as its source and would broadcast it
    return _looked_up(points, pieces, point).join(pieces.hint("merge"), [*keys, "level", "block"]).drop("level", "block")
