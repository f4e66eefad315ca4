"""Readers of source collections, writers of results, and tables in the shared folder."""

from __future__ import annotations

import html
import tempfile
import tomllib
import uuid
from collections.abc import Sequence
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, *paths: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """(path, text) of whole UTF-8 files under ``paths``, folders included; ``suffixes`` limit the names."""
    glob = None if not suffixes else "*" + suffixes[0] if len(suffixes) == 1 else "*{" + ",".join(suffixes) + "}"
    files = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_config(path: str) -> dict:
    """A TOML file of rules or settings; small, so the driver reads it."""
    with Path(path).open("rb") as f:
        return tomllib.load(f)


def config_rows(spark: SparkSession, config: dict, file: str) -> DataFrame:
    """(key, value, file) of every setting, keys joined by dots."""
    rows: list[tuple[str, str, str]] = []

    def walk(prefix: str, value: object) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else k, v)
        else:
            rows.append((prefix, str(value), file))

    walk("", config)
    return spark.createDataFrame(rows, "key string, value string, file string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_texts(rendered: DataFrame, path: str) -> None:
    """One folder ``path=...`` with one text file for each row of (path, text); paths must be distinct."""
    rendered.select("path", "text").write.partitionBy("path").mode("overwrite").text(path)


def summary_html(tally: DataFrame, title: str, most: int = 500) -> str:
    """An HTML table of a small summary: the ``most`` first rows by its first column; if there are more, it says how many it leaves out."""
    rows = tally.orderBy(tally.columns[0]).limit(most).collect()
    left = tally.count() - len(rows) if len(rows) == most else 0
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in tally.columns)
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>" + (f"<p>{left} more rows are not shown.</p>" if left else "")


#: Where the tables of ``stored`` lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a temporary folder (tests);
    any other master is an error, since its executors could not read such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, and a lost executor costs no more than a second read. Spark's reader holds up to 4,096 rows of a file
    at once; where rows are large, ``rows_per_file`` bounds that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(t))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def marked(docs: DataFrame, key: Column, keys: DataFrame, most_bits: int = 25) -> DataFrame:
    """``docs`` with ``__near``, which is false only where ``key``, a long, is not in ``keys`` (distinct).

    A bitmap of hashed keys (4 MB at most) tells; so texts that no later join can
    meet need not be shuffled for it. Where there are too many keys for the bitmap, more rows are near than need be.
    """
    bits = min(most_bits, max(16, keys.count().bit_length() + 5))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    bit = lambda p: F.expr(f"shiftleft(1L, cast({p} & 63 as int))")
    words = keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(bit("p")).alias("__marks"))
    placed = docs.withColumn("__place", place(key)).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(words), "__word", "left")
    return placed.withColumn("__near", F.coalesce(F.col("__marks").bitwiseAND(bit("__place")) != 0, F.lit(False))).drop("__place", "__word", "__marks")


class Gathered:
    """The rows of many rounds. Each round is stored; after ``merged_after`` of them the earlier ones become one table and are deleted, so plans stay short."""

    def __init__(self, name: str, merged_after: int = 16):
        self.name, self.merged_after = name, merged_after
        self.tables: list[DataFrame] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Store ``df`` as the newest round; rounds before it must not be read by themselves any more."""
        newest = stored(df, self.name)
        if len(self.tables) >= self.merged_after:
            self.tables = [self.whole()]
        self.tables.append(newest)
        return newest

    def rows(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def whole(self) -> DataFrame:
        """All rows as one stored table, in place of those of the rounds."""
        if len(self.tables) == 1:
            return self.tables[0]
        found = stored(self.rows(), self.name)
        drop(*self.tables)
        self.tables = [found]
        return found
