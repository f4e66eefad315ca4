"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop, marked, stored  # noqa: F401  shared with the other operators

T = TypeVar("T")
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A-Z become a-z; other ASCII characters but digits and a-z become spaces; the rest stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: What an operator keeps in a Python worker from task to task.
_KEPT: dict[tuple[str, str], object] = {}


def kept_in_worker(operator: str, name: str, make: Callable[[], T]) -> T:
    """The object that ``make`` gives, kept for later tasks of this worker; what other operators kept goes."""
    if (operator, name) not in _KEPT:
        free_worker()
        _KEPT[operator, name] = make()
    return _KEPT[operator, name]


def free_worker() -> None:
    """Let go what other operators kept in this worker."""
    _KEPT.clear()
    give_back()


def give_back() -> None:
    """Return to the system what allocators of this worker hold for later use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` over Arrow batches, after which a waiting worker holds no memory that is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def column(name: str) -> Column:
    """The top-level column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is tuned for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(docs: DataFrame, text_col: str = "text", bucket_bytes: int = 8 << 20) -> int:
    """How many parts to deal what is derived from the texts into, so that a part's size does not grow with the input."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    return max(partitions(docs.sparkSession), -(-size // bucket_bytes))


def keyed(docs: DataFrame, key: Column) -> DataFrame:
    """``docs`` under the names c0, c1 and so on, with ``key``: no name of theirs can clash with one of a step."""
    return docs.select(*map(column, docs.columns), key).toDF(*(f"c{i}" for i in range(len(docs.columns))), "key")


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns c0, c1 and so on under ``names``."""
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key``, a long that is never null, is not in ``keys`` (distinct)."""
    both = marked(keyed(docs, key), F.col("key"), keys)
    left = both.where("__near").join(keys.select(F.col(keys.columns[0]).alias("key")), "key", "left_anti")
    return named(both.where("not __near").unionByName(left), docs.columns)


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Make a session ready for the registered queries, once per context.

    The executors get the package, as by ``--py-files``. Arrow batches get ``batch_rows`` rows unless the session says otherwise: texts are long, and
    a batch of 10,000 would be held several times over in each task.
    """
    context = spark.sparkContext
    if getattr(context, "_sievework_ready", False):
        return
    if context.getConf().get(BATCH_ROWS) is None:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="sievework-")) / "sievework.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sievework_ready = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
