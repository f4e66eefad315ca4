"""Line facts and the checks that look at one line: scan, explode, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TAIL, raw_line, without_tail


def lines(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line_no from 0, raw); carriage returns at line ends are no part of a line."""
    exploded = df.select(F.col(path_col).alias("path"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return exploded.select("path", "line_no", raw_line(F.col("line")).alias("raw"))


def _found(rows: DataFrame, code: str, first: Column, end: Column, message: Column) -> DataFrame:
    return rows.select("path", F.lit(code).alias("code"), "line_no", first.cast("int").alias("first"), end.cast("int").alias("end"), message.alias("message"))


def trailing_space(rows: DataFrame) -> DataFrame:
    """ST001: spaces or tabs at a line's end, with their column range; lines of white space count."""
    size = F.length("raw")
    return _found(rows.where(F.rlike("raw", F.lit(TAIL))), "ST001", F.length(without_tail(F.col("raw"))), size, F.lit("trailing white space"))


def tabs(rows: DataFrame) -> DataFrame:
    """ST002: the first tab before the trailing white space, once a line."""
    at = F.instr(without_tail(F.col("raw")), "\t")
    return _found(rows.where(at > 0), "ST002", at - 1, at, F.lit("tab character"))


def wide_lines(rows: DataFrame, most: int = 100) -> DataFrame:
    """ST003: lines of more than ``most`` characters; 0 switches the check off."""
    wide = rows.where(F.length("raw") > most) if most else rows.limit(0)
    return _found(wide, "ST003", F.lit(most), F.length("raw"), F.format_string("line width %d is over %d", F.length("raw"), F.lit(most)))


def style(rows: DataFrame, most: int = 100) -> DataFrame:
    return trailing_space(rows).unionByName(tabs(rows)).unionByName(wide_lines(rows, most))


def joined_lines(rows: DataFrame) -> DataFrame:
    """(path, line_no of the first, raw): lines that end in a backslash join with the next ones."""
    by = Window.partitionBy("path").orderBy("line_no")
    starts = F.when(F.coalesce(F.lag(F.rlike("raw", F.lit(r"\\$"))).over(by), F.lit(False)), 0).otherwise(1)
    grouped = rows.withColumn("g", F.sum(starts).over(by))
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.regexp_replace("raw", r"\\$", "").alias("raw"))))
    return grouped.groupBy("path", "g").agg(parts.alias("parts")).select("path", F.col("parts")[0]["line_no"].alias("line_no"), F.array_join(F.transform("parts", lambda x: x["raw"]), "").alias("raw"))


def split_after(rows: DataFrame, pattern: str, gap: str) -> DataFrame:
    """(path, line_no, part_no, part): lines cut after ``pattern`` where ``gap`` follows, which goes."""
    parts = F.split(F.regexp_replace("raw", f"({pattern}){gap}", "$1\n"), "\n", -1)
    return rows.select("path", "line_no", F.posexplode(parts).alias("part_no", "part"))


#: Alternatives of the plain token pattern, longest symbols first.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|<<|>>|<=|>=|==|!=|&&|\|\||[^\sA-Za-z0-9_]"


def tokens(rows: DataFrame, keywords: DataFrame | None = None, pattern: str = TOKEN) -> DataFrame:
    """(path, line_no, ord, content, type): plain tokens of each line; ``keywords`` (content, type) refine identifiers."""
    found = rows.select("path", "line_no", F.posexplode(F.regexp_extract_all("raw", F.lit(f"({pattern})"), F.lit(1))).alias("ord", "content"))
    base = F.when(F.rlike("content", F.lit("^[A-Za-z_]")), "id").when(F.rlike("content", F.lit("^[0-9]")), "literal.number").otherwise("symbol")
    if keywords is None:
        return found.withColumn("type", base)
    named = keywords.select("content", F.col("type").alias("named"))
    return found.join(named, "content", "left").select("path", "line_no", "ord", "content", F.coalesce("named", base).alias("type"))


def token_counts(rows: DataFrame, keywords: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(content, n, type) of all tokens: counted first, so ``keywords`` join distinct contents and no token crosses a shuffle by itself."""
    counted = tokens(rows, None, pattern).groupBy("content", "type").agg(F.count("*").alias("n"))
    return counted.join(keywords.select("content", F.col("type").alias("named")), "content", "left").select("content", "n", F.coalesce("named", "type").alias("type"))


def bracket_depth(found: DataFrame, openers: str = "([{", closers: str = ")]}") -> DataFrame:
    """Tokens with ``depth``: brackets that are open before each one."""
    step = F.when(F.instr(F.lit(openers), F.col("content")) > 0, 1).when(F.instr(F.lit(closers), F.col("content")) > 0, -1).otherwise(0)
    before = Window.partitionBy("path").orderBy("line_no", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))).drop("step")


def unbalanced(tags: DataFrame) -> DataFrame:
    """Per path and tag the counts of opening and closing marks, where they differ. ``tags``: path, tag, step (1 or -1)."""
    counted = tags.groupBy("path", "tag").agg(F.count_if(F.col("step") > 0).alias("opened"), F.count_if(F.col("step") < 0).alias("closed"))
    return counted.where("opened <> closed")
