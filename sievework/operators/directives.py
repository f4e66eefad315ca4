"""Ordered directives: redefinition, values in force, suppressed ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored
from . import intervals


def directive_lines(rows: DataFrame, prefix: str) -> DataFrame:
    """(path, line_no, name, rest) of lines whose first non-blank characters are ``prefix``."""
    text = F.regexp_replace("raw", r"^\s+", "")
    body = F.regexp_replace(F.substring(text, F.lit(len(prefix) + 1), F.length(text)), r"^\s+", "")
    return rows.where(F.startswith(text, F.lit(prefix))).select("path", "line_no", F.regexp_extract(body, r"^(\S*)", 1).alias("name"), F.regexp_extract(body, r"^\S*\s+(.*)$", 1).alias("rest"))


def redefinitions(events: DataFrame) -> DataFrame:
    """MH002: definitions whose last event of the same name defined another known value.

    ``events``: path, name, seq, op ('define' or 'undef'), value (null: unknown). An undef
    forgets; an unknown value is remembered as unknown and never compared.
    """
    by = Window.partitionBy("path", "name").orderBy("seq")
    seen = events.select("*", F.lag("op").over(by).alias("last_op"), F.lag("value").over(by).alias("last_value"))
    return seen.where("op = 'define' and last_op = 'define' and value <> last_value").drop("last_op")


def last_values(events: DataFrame, restore: str) -> DataFrame:
    """MH001: (path, value) where the last event's value is not ``restore``."""
    last = events.groupBy("path").agg(F.max_by("value", "seq").alias("value"))
    return last.where(F.col("value") != restore)


def in_force(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Each call with the params of the last event of its name at or before its line.

    ``calls``: path, name, line, call_id and more; ``events``: path, name, line, seq, params (null
    for undef and for names without parameters). Calls without an earlier event are absent; those whose event has
    null params are kept, so the caller can tell them apart. One window over both sides, so
    each row is read once, however many events a name has.
    """
    extra = [c for c in calls.columns if c not in ("path", "name", "line")]
    call = calls.select("path", "name", "line", F.struct(*extra).alias("call"), F.lit(None).cast(events.select(F.struct("seq", "params")).schema[0].dataType).alias("event"))
    event = events.select("path", "name", "line", F.lit(None).cast(call.schema["call"].dataType).alias("call"), F.struct("seq", "params").alias("event"))
    by = Window.partitionBy("path", "name").orderBy("line", F.col("event").isNull(), "event.seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = call.unionByName(event).withColumn("last", F.last("event", ignorenulls=True).over(by))
    return placed.where("call is not null and last is not null").select("path", "name", "line", "call.*", F.col("last.params").alias("params"))


def wrong_argument_counts(placed: DataFrame) -> DataFrame:
    """MAC001 from ``in_force`` rows with slots and single_empty (one empty slot was given).

    A last parameter ``...`` makes the named ones the least count; no parameters ask for exactly one empty slot.
    """
    n = F.size("params")
    variadic = F.coalesce(F.get("params", n - 1) == "...", F.lit(False))
    fine = F.when(n == 0, (F.col("slots") == 1) & F.col("single_empty")).when(variadic, F.col("slots") >= n - 1).otherwise(F.col("slots") == n)
    return placed.where(F.col("params").isNotNull() & ~fine)


def suppressed_ranges(marks: DataFrame) -> DataFrame:
    """(path, start, end) from marks (path, line, op: 'off' or 'on'); start counts, end does not, null end runs on.

    Only the first 'off' of a run opens a range, and the next 'on' closes it.
    """
    by = Window.partitionBy("path").orderBy("line")
    change = marks.withColumn("last", F.lag("op").over(by)).where("op <> coalesce(last, 'on')")
    return change.withColumn("end", F.lead("line").over(by)).where("op = 'off'").select("path", F.col("line").alias("start"), "end")


def unsuppressed(diagnostics: DataFrame, ranges: DataFrame) -> DataFrame:
    """Diagnostics (path, line and more) that start in no range (path, start, end); those without a line always stay."""
    return intervals.outside(diagnostics, ranges.select("path", F.col("start").alias("first"), "end"), ["path"], "line")


def not_silenced(diagnostics: DataFrame, silenced: DataFrame) -> DataFrame:
    """Diagnostics (path, line, code and more) that no row of ``silenced`` (path, first, end, codes: null for all) holds with their code."""
    silenced = stored(silenced, "silenced")  # read twice; few rows, but much work to find
    by_code = silenced.where("codes is not null").select("path", "first", "end", F.explode("codes").alias("code"))
    left = intervals.outside(diagnostics, silenced.where("codes is null").select("path", "first", "end"), ["path"], "line")
    return intervals.outside(left, by_code, ["path", "code"], "line")
