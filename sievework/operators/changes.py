"""Incremental work: which files and lines differ between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change: added, removed or edited) between two tables (path, text); equal texts are left out."""
    a = old.select("path", F.sha2("text", 256).alias("was"), F.lit(True).alias("in_old"))
    b = new.select("path", F.sha2("text", 256).alias("is"), F.lit(True).alias("in_new"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "edited")
    return both.select("path", change.alias("change")).where("change is not null")


def damaged_range(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, first, old_end, new_end): the lines between the common head and the common tail of edited files.

    ``old`` and ``new``: path, line_no (from 0, no gaps), raw; files of one side only and equal files are left out. Lines are compared by two 64-bit hashes; only these cross a shuffle, once with
    the files' sizes and once by their places from either end.
    """
    hashed = F.struct(F.xxhash64("raw").alias("h"), F.xxhash64(F.lit(1), "raw").alias("g"))
    side = lambda d, n: d.select("path", "line_no", F.lit(n).alias("side"), hashed.alias("hash"))
    rows = side(old, 0).unionByName(side(new, 1))
    sizes = rows.groupBy("path").agg(F.count_if(F.col("side") == 0).alias("old_n"), F.count_if(F.col("side") == 1).alias("new_n")).where("old_n > 0 and new_n > 0")
    own = F.when(F.col("side") == 0, F.col("old_n")).otherwise(F.col("new_n"))
    ends = F.array(F.struct(F.lit(0).alias("tail"), F.col("line_no").cast("long").alias("k")), F.struct(F.lit(1).alias("tail"), (own - F.col("line_no")).alias("k")))
    placed = rows.join(sizes, "path").select("path", "old_n", "new_n", "side", "hash", F.explode(ends).alias("e"))
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("hash")))
    both = placed.groupBy("path", "old_n", "new_n", "e.tail", "e.k").agg(of(0).alias("a"), of(1).alias("b"))
    differ = lambda tail: F.min(F.when((F.col("tail") == tail) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")), F.col("k")))
    found = both.groupBy("path", "old_n", "new_n").agg(differ(0).alias("head"), (differ(1) - 1).alias("tail")).where("head is not null or old_n <> new_n")
    n = F.least("old_n", "new_n")
    first = F.coalesce("head", n)
    kept = F.least(F.coalesce("tail", n), n - first)
    return found.select("path", first.alias("first"), (F.col("old_n") - kept).alias("old_end"), (F.col("new_n") - kept).alias("new_end"))
