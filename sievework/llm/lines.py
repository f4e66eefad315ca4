"""Operator 10: line dedup by winnowing over line hashes, in built-in functions only.

Each document is a sequence of line hashes. Of every window of ``least_lines``
consecutive lines the smallest hash is a fingerprint, so two copies of such a run
select the same line. Fingerprints seen more than once are extended both ways to
all runs of that length that hold them; a run whose lines start a run earlier
already (smaller id, or same document, smaller line number) is deleted, and
overlapping deletions join into longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop, marked, stored

_WORD = r"[^\x20\x09-\x0D]"


def _runs(numbered: Column, w: int) -> Column:
    """Fingerprints of ``numbered`` (line number i, hashes h and g), each with the runs that hold it."""

    def run(s: Column) -> Column:
        part = F.slice(numbered, s + 1, w)
        return F.struct(
            F.element_at(part, 1)["i"].alias("from_line"),
            F.element_at(part, -1)["i"].alias("to_line"),
            F.xxhash64(F.transform(part, lambda x: x["h"])).alias("r1"),
            F.xxhash64(F.transform(part, lambda x: x["g"])).alias("r2"),
        )

    last = F.size(numbered) - w

    def minimum(i: Column) -> Column:
        least = F.array_min(F.transform(F.slice(numbered, i + 1, w), lambda x, j: F.struct(x["h"].alias("h"), (-j).alias("j"))))
        return i - least["j"]

    def fingerprint(p: Column) -> Column:
        starts = F.sequence(F.greatest(F.lit(0), p - (w - 1)), F.least(p, last))
        return F.struct(F.get(numbered, p)["h"].alias("f"), F.transform(starts, run).alias("runs"))

    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), last), minimum))
    return F.transform(chosen, fingerprint)


def line_dedup(df: DataFrame, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``df`` with later repeated runs of at least ``least_lines`` lines deleted from its texts.

    Lines are what lies between ``\\n``; lines without a word are skipped when runs are
    formed and go only with a run around them. Runs are judged on the input. All
    columns stay; with ``counts``, ``n_lines`` and ``n_removed`` are appended. A null text
    stays null; texts with fewer lines, empty ones included, stay as they are. Rows that
    share an id count as one place: of equal runs at equal lines none is later. A null
    id comes after all others. An empty table gives no rows.
    """
    w = least_lines
    rest = [c for c in df.columns if c != text_col]
    docs = df.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("rest"),
        column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("key"), F.split(column(text_col), "\n", -1).alias("lines"),
    )
    numbered = F.filter(
        F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(_WORD), F.xxhash64(x)).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))),
        lambda x: x["h"].isNotNull(),
    )
    prints = (
        docs.where(F.size("lines") >= w).select("id", "key", numbered.alias("numbered")).where(F.size("numbered") >= w)
        .select("id", "key", F.inline(_runs(F.col("numbered"), w)))
    )
    repeated = stored(prints.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "fingerprints")
    runs = stored(prints.join(repeated, "f").select("id", "key", F.inline("runs")), "runs")
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("from_line").alias("l"))
    first = stored(runs.groupBy("r1", "r2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("r1", "r2", "first"), "first-runs")
    later = runs.join(first, ["r1", "r2"]).where(place > F.col("first"))  # stored tables on both sides: a very common run is split
    deleted = stored(later.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("from_line", "to_line"))).alias("gone")), "deleted")
    drop(repeated, runs, first)
    placed = marked(docs, F.xxhash64("id", "key"), deleted.select(F.xxhash64("id", "key").alias("k")).distinct())
    changed = placed.where("__near").alias("d").join(deleted.alias("x"), F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.key") == F.col("x.key")), "left").select("rest", "lines", "gone")
    joined = placed.where("not __near").select("rest", "lines", F.lit(None).cast(deleted.schema["gone"].dataType).alias("gone")).unionByName(changed)
    n = F.size("gone")
    between = F.transform(
        F.sequence(F.lit(0), n),
        lambda j: F.struct(
            F.when(j == 0, F.lit(0)).otherwise(F.get(F.col("gone"), j - 1)["to_line"] + 1).alias("a"),
            F.when(j == n, F.size("lines")).otherwise(F.get(F.col("gone"), j)["from_line"]).alias("b"),
        ),
    )
    kept = F.flatten(F.transform(F.filter(between, lambda x: x["b"] > x["a"]), lambda x: F.slice(F.col("lines"), x["a"] + 1, x["b"] - x["a"])))
    left = joined.select("rest", F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
    columns = [F.array_join("kept", "\n").alias(text_col) if c == text_col else F.col(f"rest.c{rest.index(c)}").alias(c) for c in df.columns if not (counts and c in ("n_lines", "n_removed"))]
    extra = [F.col("n_lines"), (F.col("n_lines") - F.when(F.col("kept").isNotNull(), F.size("kept")).otherwise(0)).cast("long").alias("n_removed")] if counts else []
    return left.select(*columns, *extra)
