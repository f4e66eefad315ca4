"""Places in derived text brought back to sources, spans that cover a change, edits applied by span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals


def source_lines(found: DataFrame, line_map: DataFrame) -> DataFrame:
    """Findings (path, line from 0) with ``source_line``: that of ``line_map`` (path, out_line from 0, src_line from 1), else their own."""
    mapped = line_map.select("path", F.col("out_line").alias("line"), (F.col("src_line") - 1).alias("mapped"))
    return found.join(mapped, ["path", "line"], "left").withColumn("source_line", F.coalesce("mapped", "line")).drop("mapped")


def macro_of_line(found: DataFrame, regions: DataFrame, order: str = "ord") -> DataFrame:
    """Findings (path, line) with the macro of the region (path, macro, first, end, ``order``) that holds their line and has the smallest ``order``, or null."""
    return intervals.best_at(found, regions, ["path"], "line", F.col(order), F.col("macro"), "macro")


def narrowest_region(found: DataFrame, regions: DataFrame) -> DataFrame:
    """Places (path, line and more) with ``region``: the node of the narrowest region (path, node, first, end) that holds the line; of equal ones the last to begin, then the smallest node."""
    order = F.struct(F.col("end") - F.col("first"), -F.col("first"), "node")
    return intervals.best_at(found, regions, ["path"], "line", order, F.col("node"), "region")


def covering_spans(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, edit_first, edit_end, node, depth): spans (path, node, first, end) that cover an edit (path, edit_first, edit_end: at least one place), the outermost at depth 0."""
    over = intervals.holding(edits, spans, ["path"], "edit_first").where("edit_end <= end")
    by = Window.partitionBy("path", "edit_first", "edit_end").orderBy(F.desc(F.col("end") - F.col("first")), "first", "node")
    return over.select("path", "edit_first", "edit_end", "node", (F.row_number().over(by) - 1).alias("depth"))


def change_ratio_limit(tokens: Column) -> Column:
    """The share of changed tokens up to which work is incremental: 0.2, rising to 0.3 at 20,000 tokens."""
    return F.lit(0.2) + 0.1 * F.least(tokens, F.lit(20_000)) / 20_000


def apply_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text) with the spans [first, end) of ``edits`` (path, first, end, new) replaced; spans must not overlap."""
    listed = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("first", "end", "new"))).alias("e"))
    n = F.size("e")
    cut = lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    piece = lambda x, i: F.concat(cut(F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("e"), i - 1)["end"]), x["first"]), x["new"])
    tail = cut(F.get(F.col("e"), n - 1)["end"], F.length("text"))
    edited = F.concat(F.array_join(F.transform("e", piece), ""), tail)
    return texts.join(listed, "path", "left").select("path", F.when(F.col("e").isNull(), F.col("text")).otherwise(edited).alias("text"))
