"""Conditional regions: nesting, active lines, configurations. Running sums and windows, no stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def branches(marks: DataFrame) -> DataFrame:
    """Branches of conditional blocks: path, level, block, line, op, name (of the block), branch (from 0), end (null: never closed).

    ``marks``: path, line, op ('if', 'else', 'endif'), name (of an 'if'). An 'else' or 'endif' outside of any
    block is ignored. A branch ends where the next mark of its block stands.
    """
    by = Window.partitionBy("path").orderBy("line")
    step = F.when(F.col("op") == "if", 1).when(F.col("op") == "endif", -1).otherwise(0)
    summed = marks.withColumn("s", F.sum(step).over(by))
    depth = F.col("s") - F.least(F.lit(0), F.min("s").over(by))  # unmatched ends do not count
    deep = summed.withColumn("depth", depth).withColumn("before", F.coalesce(F.lag("depth").over(by), F.lit(0)))
    placed = deep.withColumn("level", F.when(F.col("op") == "endif", F.col("before")).otherwise(F.col("depth"))).where("level > 0")
    in_level = Window.partitionBy("path", "level").orderBy("line")
    blocked = placed.withColumn("block", F.sum((F.col("op") == "if").cast("int")).over(in_level))
    in_block = Window.partitionBy("path", "level", "block").orderBy("line")
    named = blocked.select("path", "level", "block", "line", "op", F.first("name").over(in_block).alias("name"), (F.row_number().over(in_block) - 1).alias("branch"), F.lead("line").over(in_block).alias("end"))
    return named.where("op <> 'endif'")


def unclosed(found: DataFrame) -> DataFrame:
    """(path, line, name): blocks of ``branches`` that are open at the end, by the line of their 'if'."""
    last = found.groupBy("path", "level", "block").agg(F.min("line").alias("line"), F.first("name").alias("name"), F.max(F.col("end").isNull()).alias("open"))
    return last.where("open").select("path", "line", "name")


def active_lines(rows: DataFrame, untaken: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """Rows that lie in no untaken branch (the keys, line, end): a running count of those open is nought.

    Each row is read once, however deep the nesting.
    """
    extra = [c for c in rows.columns if c not in (*keys, line)]
    at = rows.select(*keys, F.col(line).alias("__at"), F.lit(0).alias("__step"), F.struct(*extra, F.lit(1).alias("__")).alias("__row"))
    none = F.lit(None).cast(at.schema["__row"].dataType).alias("__row")
    opened = untaken.select(*keys, F.col("line").alias("__at"), F.lit(1).alias("__step"), none)
    closed = untaken.where("end is not null").select(*keys, F.col("end").alias("__at"), F.lit(-1).alias("__step"), none)
    by = Window.partitionBy(*keys).orderBy("__at")  # equal places count together
    counted = at.unionByName(opened).unionByName(closed).withColumn("__open", F.sum("__step").over(by))
    return counted.where("__row is not null and __open = 0").select(*keys, F.col("__at").alias(line), *(F.col(f"__row.`{c}`").alias(c) for c in extra))


def untaken(found: DataFrame, defined: Column) -> DataFrame:
    """Branches that are not active by themselves: the 'if' where ``defined`` fails, the first 'else' where it holds, later ones."""
    taken = F.when(F.col("branch") == 0, defined).otherwise((F.col("branch") == 1) & ~defined)
    return found.where(~taken).select("path", "line", "end")


def configurations(found: DataFrame, most: int) -> DataFrame:
    """(path, config, level, block, arm, n_all): choices of one arm for each block, the first ``most`` combinations of a path; ``n_all`` says how many there are.

    Arms are a block's branches and, where it has no 'else', none of them. Combinations are counted like
    digits, blocks in order of their first line, so no join is needed.
    """
    arms = found.groupBy("path", "level", "block").agg(F.min("line").alias("line"), F.greatest(F.max("branch") + 1, F.lit(2)).alias("n"))
    blocks = arms.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "level", "block", "n"))).alias("blocks"))
    size = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda x, b: F.least(x * b["n"], F.lit(most).cast("long")))
    total = F.aggregate("blocks", F.lit(1.0), lambda x, b: x * b["n"])
    each = blocks.select("path", "blocks", total.alias("n_all"), F.explode(F.sequence(F.lit(0).cast("long"), size(F.col("blocks")) - 1)).alias("config"))
    digits = each.select("path", "config", "n_all", F.posexplode("blocks").alias("i", "b"), size(F.slice("blocks", 1, F.col("i"))).alias("weight"))
    arm = F.when(F.col("weight") >= most, 0).otherwise(F.expr("config div weight") % F.col("b.n"))
    return digits.select("path", "config", "b.level", "b.block", arm.cast("int").alias("arm"), "n_all")


def in_configurations(rows: DataFrame, found: DataFrame, configs: DataFrame, line: str = "line_no") -> DataFrame:
    """``rows`` once for each configuration of their path in which they are active (config 0 where a path has no blocks)."""
    off = found.join(configs.drop("n_all"), ["path", "level", "block"]).where("branch <> arm").select("path", "config", "line", "end")
    all_configs = configs.select("path", "config").distinct()
    each = rows.join(all_configs, "path", "left").withColumn("config", F.coalesce("config", F.lit(0).cast("long")))
    return active_lines(each, off, ["path", "config"], line)


def merged_findings(findings: DataFrame, found: DataFrame, configs: DataFrame, line: str = "line_no") -> DataFrame:
    """Findings, equal ones of all configurations as one row, with ``configs`` (in which they hold, ascending), ``n_tried`` and ``n_all`` of their path."""
    columns = findings.columns
    held = in_configurations(findings, found, configs, line).groupBy(*columns).agg(F.sort_array(F.collect_set("config")).alias("configs"))
    tried = configs.groupBy("path").agg(F.count_distinct("config").alias("n_tried"), F.max("n_all").alias("n_all"))
    one = {"n_tried": F.coalesce("n_tried", F.lit(1).cast("long")), "n_all": F.coalesce("n_all", F.lit(1.0))}
    return held.join(tried, "path", "left").withColumns(one)


def regions(flags: DataFrame, keys: list[str], line: str = "line_no", flag: str = "flag") -> DataFrame:
    """(keys, first, end): runs of lines next to each other whose flag is set."""
    run = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return flags.where(F.col(flag)).withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(line).alias("first"), (F.max(line) + 1).alias("end")).drop("__run")


def annotated(found: DataFrame, ends: DataFrame, rows: DataFrame, marker: str = "// ") -> DataFrame:
    """Lines (path, line_no, raw) with ``annotated``: those of 'else' and 'endif' end in their block's name; a second run changes nothing.

    ``found``: of ``branches``; ``ends``: path, line, name of closing marks.
    """
    names = found.where("op = 'else'").select("path", F.col("line").alias("line_no"), "name").unionByName(ends.select("path", F.col("line").alias("line_no"), "name"))
    tail = F.concat(F.lit(marker), "name")
    text = F.when(F.col("name").isNull() | F.endswith("raw", tail), F.col("raw")).otherwise(F.concat(F.rtrim("raw"), F.lit(" "), tail))
    return rows.join(names, ["path", "line_no"], "left").withColumn("annotated", text).drop("name")
