"""Formatting that is relational: groups of lines, column widths, padding, indentation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, keys: Sequence[str], position: str, distance: int) -> DataFrame:
    """Rows with ``island``: a number that grows where the next row of the key is more than ``distance`` away."""
    by = Window.partitionBy(*keys).orderBy(position)
    far = F.coalesce(F.col(position) - F.lag(position).over(by) > distance, F.lit(False))
    return rows.withColumn("island", F.sum(far.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def column_widths(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The largest length of each column in a group."""
    return rows.groupBy(*keys).agg(*(F.max(F.length(c)).alias(f"{c}_width") for c in columns))


def aligned(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], gap: str = " ") -> DataFrame:
    """Rows with ``aligned``: their columns padded to the group's widths, white space at the end cut."""
    by = Window.partitionBy(*keys)
    cells = [F.rpad(F.coalesce(c, F.lit("")), F.max(F.length(c)).over(by), " ") for c in columns]
    return rows.withColumn("aligned", F.rtrim(F.concat_ws(gap, *cells)))


def indented(rows: DataFrame, depth: str = "depth", text: str = "raw", width: int = 4) -> DataFrame:
    """Lines with ``indented``: their text after ``depth`` levels; blank lines become empty."""
    body = F.regexp_replace(F.col(text), r"^[ \t]+|[ \t]+$", "")
    level = F.greatest(F.lit(0), F.col(depth)).cast("int")
    return rows.withColumn("indented", F.when(body == "", "").otherwise(F.concat(F.repeat(F.lit(" "), level * width), body)))


def best_break(candidates: DataFrame, keys: Sequence[str], penalty: Column, position: str = "at") -> DataFrame:
    """The cheapest break of each line; of equal ones the rightmost."""
    return candidates.groupBy(*keys).agg(F.min_by(position, F.struct(penalty, -F.col(position))).alias(position))


def break_points(rows: DataFrame, width: int) -> DataFrame:
    """(path, line_no, break_at): the space of each line where a break costs least: what is over ``width`` before it, and twice what is over after it.

    Of equal ones the rightmost; one pass over the line's words, inside the row. Lines without a space before their last character are left out.
    """
    none = F.lit(None).cast("int")
    start = F.struct(F.length("raw").alias("size"), F.lit(0).alias("at"), none.alias("cost"), none.alias("best"))  # the length is taken once

    def step(state: Column, word: Column) -> Column:
        size, at = state["size"], state["at"] + F.length(word) + 1
        cost = F.greatest(at - width, F.lit(0)) + 2 * F.greatest(size - at - width, F.lit(0))
        better = (at < size) & (state["cost"].isNull() | (cost <= state["cost"]))
        return F.struct(size.alias("size"), at.alias("at"), F.when(better, cost).otherwise(state["cost"]).alias("cost"), F.when(better, at).otherwise(state["best"]).alias("best"))

    words = F.split("raw", " ", -1)
    found = rows.withColumn("break_at", F.aggregate(F.slice(words, 1, F.size(words) - 1), start, step)["best"])
    return found.where("break_at is not null").select("path", "line_no", "break_at")


def wrapped(rows: DataFrame, width: int, marker: str = "//") -> DataFrame:
    """(path, line_no, part_no, part): comment lines of more than ``width`` characters, filled anew word by word; other lines are their only part.

    A comment line begins with ``marker`` after white space; its parts begin with the same white space, the marker and a space. A part is as long as fits into ``width``, but a word
    that is longer by itself stays whole. Done within the row.
    """
    mark = re.escape(marker)
    lead, text = F.regexp_extract("raw", rf"^(\s*){mark}", 1), F.regexp_replace("raw", rf"^\s*{mark}\s*|\s+$", "")
    head = F.concat(lead, F.lit(marker + " "))
    # the longest run of whole words that fits, else one long word; a regular expression, since functions over arrays are not compiled
    room = F.greatest(F.lit(width - len(marker) - 1) - F.length(lead), F.lit(1)).cast("string")
    filled = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.concat(F.lit("(?s) ?(.{1,"), room, F.lit(r"}(?= |\z)|[^ ]+)")), F.lit(1))
    wide = F.rlike("raw", F.lit(rf"^\s*{mark}")) & (F.length("raw") > width) & (text != "")
    each = rows.select("path", "line_no", F.when(wide, head).otherwise("").alias("head"), F.posexplode(F.when(wide, filled).otherwise(F.array("raw"))).alias("part_no", "part"))
    return each.select("path", "line_no", "part_no", F.concat("head", "part").alias("part"))


def depth_of_lines(rows: DataFrame, opener: str, closer: str) -> DataFrame:
    """Lines with ``depth``: blocks open before them, from counts of words that open and close; a closing line counts as closed."""
    count = lambda w: F.size(F.regexp_extract_all("raw", F.lit(rf"(\b(?:{w})\b)"), F.lit(1)))
    by = Window.partitionBy("path").orderBy("line_no")
    step = rows.withColumn("o", count(opener)).withColumn("c", count(closer))
    before = F.coalesce(F.sum(F.col("o") - F.col("c")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    closes = F.rlike("raw", F.lit(rf"^\s*(?:{closer})\b")).cast("int")
    return step.withColumn("depth", (before - closes).cast("int")).drop("o", "c")
