"""Matching of openers and closers by depth and rank: windows and running sums, no stack.

A closer takes the last open opener, whether their kinds agree or not; a closer without one is unmatched. So at each
depth openers and closers take turns, and an opener's closer is the next row of its depth. Marks are
matched within chunks of lines first; only what a chunk leaves open meets over the whole path, so one
very long path is no one task's work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def after(marks: DataFrame, kept: Column, name: str, value: Column, line: str = "line_no", order: str = "ord", chunk: int = 4096) -> DataFrame:
    """``marks`` with ``name``: ``value`` of the last earlier row of the path where ``kept`` holds; looked up in chunks of lines."""
    held = F.when(kept, F.struct(value.alias("v")))
    placed = marks.withColumn("__chunk", F.floor(F.col(line) / chunk))
    before = Window.partitionBy("path", "__chunk").orderBy(line, order).rowsBetween(Window.unboundedPreceding, -1)
    last = placed.groupBy("path", "__chunk").agg(F.max_by(held, F.when(held.isNotNull(), F.struct(line, order))).alias("__last"))
    carried = last.withColumn("__carried", F.last("__last", ignorenulls=True).over(Window.partitionBy("path").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)))
    both = placed.withColumn("__own", F.last(held, ignorenulls=True).over(before)).join(carried.select("path", "__chunk", "__carried"), ["path", "__chunk"])
    return both.withColumn(name, F.coalesce("__own", "__carried")["v"]).drop("__chunk", "__own", "__carried")


def _matched(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Marks (path, at, opens, kind and keys) with ``level`` (0: a closer with nothing open) and the ``mate`` of an opener: its closer's at and kind."""
    by = Window.partitionBy(*keys).orderBy("at")
    summed = marks.withColumn("s", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(by))
    deep = summed.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(by)))  # closers with nothing open do not count
    level = F.when(F.col("opens"), F.col("depth")).otherwise(F.coalesce(F.lag("depth").over(by), F.lit(0)))
    in_level = Window.partitionBy(*keys, "level").orderBy("at")
    mate = F.lead(F.when(~F.col("opens"), F.struct("at", "kind"))).over(in_level)
    taken = F.coalesce(F.lag("opens").over(in_level), F.lit(False)) & ~F.col("opens") & (F.col("level") > 0)
    return deep.withColumn("level", level).select(*marks.columns, "level", F.when(F.col("opens"), mate).alias("mate"), taken.alias("taken"))


def matched(marks: DataFrame, chunk: int = 4096) -> DataFrame:
    """(path, at, kind, opens, close_at, close_kind): openers with their closers (null: never closed), and closers with nothing open.

    ``marks``: path, line_no, ord, kind, opens (false for closers); ``at`` is a struct of line_no and ord.
    """
    placed = marks.select("path", F.struct("line_no", "ord").alias("at"), "kind", "opens", F.floor(F.col("line_no") / chunk).alias("chunk"))
    near = _matched(placed, ["path", "chunk"])
    done = near.where("mate is not null")
    left = near.where("mate is null and not taken").select("path", "at", "kind", "opens")
    far = _matched(left, ["path"]).where("not taken")
    out = lambda d: d.select("path", "at", "kind", "opens", F.col("mate.at").alias("close_at"), F.col("mate.kind").alias("close_kind"))
    return out(done).unionByName(out(far))


def boundary_findings(found: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """(path, line_no, ord, finding, kind, n) from ``matched``: unmatched and mismatched closers, and one unclosed a path, at its outermost opener with how many are open.

    ``pairs``: the opener's kind for each closer's kind; a closer of another kind takes any opener.
    """
    wanted = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")
    expected = F.try_element_at(wanted, F.col("close_kind"))
    one = F.lit(1).cast("long").alias("n")
    alone = found.where("not opens").select("path", "at", F.lit("unmatched").alias("finding"), "kind", one)
    other = found.where(F.col("close_at").isNotNull() & (F.col("kind") != expected)).select("path", F.col("close_at").alias("at"), F.lit("mismatched").alias("finding"), F.col("close_kind").alias("kind"), one)
    open_ = found.where("opens and close_at is null").groupBy("path").agg(F.min_by(F.struct("at", "kind"), "at").alias("x"), F.count("*").alias("n"))
    rows = alone.unionByName(other).unionByName(open_.select("path", "x.at", F.lit("unclosed").alias("finding"), "x.kind", "n"))
    return rows.select("path", "at.line_no", "at.ord", "finding", "kind", "n")
