"""Files spliced into each other, with where each line comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import drop, stored


def expansions(includes: DataFrame, roots: DataFrame, max_depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """Where files are spliced in, and what goes wrong: two stored tables.

    ``includes``: file, line_no, target (null: not found); ``roots``: root. The first table has (root, key, file, stack): the file at the line numbers ``key``, one a
    level, with the files around it. The second has (root, key, file, line_no, target, problem): 'missing', 'cycle' (the target is around this place) or 'depth' (it
    would be deeper than ``max_depth``, the root being at 1). Each round goes one level down; a file that several others include is spliced in at each place.
    """
    known = stored(includes.select("file", "line_no", "target"), "includes")
    text = includes.schema["file"].dataType.simpleString()
    front = stored(roots.distinct().select("root", F.array().cast("array<int>").alias("key"), F.col("root").cast(text).alias("file"), F.array(F.col("root").cast(text)).alias("stack")), "expansion")
    rounds, tried = [front], []
    for depth in range(1, max_depth + 1):
        step = front.join(known, "file").select("root", F.concat("key", F.array(F.col("line_no").cast("int"))).alias("key"), "file", "line_no", "target", "stack")
        problem = F.when(F.col("target").isNull(), "missing").when(F.array_contains("stack", F.col("target")), "cycle").when(F.lit(depth >= max_depth), "depth")
        tried.append(stored(step.withColumn("problem", problem), "tried"))
        front = stored(tried[-1].where("problem is null").select("root", "key", F.col("target").alias("file"), F.concat("stack", F.array("target")).alias("stack")), "expansion")
        if front.isEmpty():
            drop(front)
            break
        rounds.append(front)
    places, problems = rounds[0], tried[0].where("problem is not null")
    for r in rounds[1:]:
        places = places.unionByName(r)
    for t in tried[1:]:
        problems = problems.unionByName(t.where("problem is not null"))
    found = stored(places, "expansions"), stored(problems.drop("stack"), "problems")
    drop(known, *rounds, *tried)
    return found


def spliced(lines: DataFrame, includes: DataFrame, places: DataFrame) -> DataFrame:
    """(root, out_line from 0, file, line_no, depth, raw): the lines of each root with those of the included files in place of the lines that include them.

    ``lines``: file, line_no, raw; ``places``: of ``expansions``. A line that includes goes, even where nothing could be spliced in.
    """
    own = lines.join(includes.select("file", "line_no").distinct(), ["file", "line_no"], "left_anti")
    each = places.select("root", "key", "file", F.size("stack").alias("depth")).join(own, "file")
    placed = each.withColumn("place", F.concat("key", F.array(F.col("line_no").cast("int"))))
    by = Window.partitionBy("root").orderBy("place")
    return placed.select("root", (F.row_number().over(by) - 1).alias("out_line"), "file", "line_no", "depth", "raw")
