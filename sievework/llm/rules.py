"""Operator 6: quality rules with adaptive thresholds from mergeable quantile sketches.

Text statistics come from one pass over each text. Quantile sketches (KLL) per
language and source are built with map-side merging; a threshold is a fence around
the median, as wide as the middle half of the group is spread. Small groups take
the fence of their language, small languages that of the whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Fences:
    """How many spreads (of the group's middle half) from the median are still kept; and, only for groups whose middle half has no spread, the distance per statistic."""

    spreads: float = 10.0
    least_rows: int = 100
    word_length: float = 2.0
    symbols: float = 0.05
    dup_lines: float = 0.3
    repeats: float = 0.1


#: Statistic -> (numerator, denominator, whether low values fail too).
RATIOS = {
    "word_length": ("word_chars", "n_words", True),
    "symbols": ("n_symbols", "word_chars", False),
    "dup_lines": ("n_dup_lines", "n_lines", False),
    "repeats": ("n_repeat_words", "n_words", False),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_stats(text: str) -> tuple[int, ...]:
    """The values of STATS; words are runs of characters other than ASCII white space."""
    data = text.encode()
    words = data.split()
    n = len(words)
    white = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else [data][: bool(n)]
    repeats = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + 5 - max(i, end)
                    end = i + 5
    return n, len(text) - white, len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeats


def with_stats(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` with the STATS of its text (null: zeros)."""
    source = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = df.select(*keep).schema
    for c in STATS:
        schema = schema.add(c, "long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = zip(*rows) if rows else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names[:-1], *STATS])

    return source.mapInArrow(measure, schema)


def _fenced(sketches: DataFrame, f: Fences, level: str) -> DataFrame:
    """Bounds from sketches: a struct column named ``level``, null for groups that are too small."""
    bounds = []
    for name, (_, _, low) in RATIOS.items():
        q = [F.kll_sketch_get_quantile_double(F.col(name), F.lit(x)) for x in (0.25, 0.5, 0.75)]
        width = F.when(q[2] > q[0], f.spreads * (q[2] - q[0])).otherwise(F.lit(getattr(f, name)))
        bounds.append((q[1] + width).alias(f"{name}_most"))
        bounds.append(((q[1] - width) if low else F.lit(-1.0)).alias(f"{name}_least"))
    keys = [c for c in sketches.columns if c not in RATIOS and c != "n"]
    return sketches.where(F.col("n") >= f.least_rows).select(*keys, F.struct(*bounds).alias(level))


def quality_rules(df: DataFrame, f: Fences = Fences(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 10, most_repeat_percent: int = 20) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeat_percent`` of 100 words lie in five-word windows found twice or more.
    The thresholds are learned from all documents that pass the base rules. Null
    languages or sources form groups of their own; a null text has no words and fails.
    Repeated rows give repeated results; an empty table gives none. While fewer than
    ``least_rows`` documents pass in all, no fence is drawn and they are kept.
    """
    stats = stored(
        with_stats(df.select(F.col(id_col), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), F.col(text_col)), [id_col, "__lang", "__source"], text_col)
        .withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))),
        "stats",
    )
    ratios = {k: F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b, _) in RATIOS.items()}
    groups = stored(
        stats.where("not base_failed").groupBy("__lang", "__source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(v).alias(k) for k, v in ratios.items())),
        "sketches",
    )
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(F.col(k)).alias(k) for k in RATIOS)]
    own = _fenced(groups, f, "own").alias("o")
    lang = _fenced(groups.groupBy("__lang").agg(*merged), f, "by_lang").alias("l")
    whole = _fenced(groups.agg(*merged), f, "whole").first()
    bounds = {x: float(whole.whole[x]) if whole else (-1.0 if x.endswith("_least") else float("inf")) for k in RATIOS for x in (f"{k}_most", f"{k}_least")}
    s = stats.alias("s")
    joined = s.join(own, F.col("s.__lang").eqNullSafe(F.col("o.__lang")) & F.col("s.__source").eqNullSafe(F.col("o.__source")), "left")
    joined = joined.join(lang, F.col("s.__lang").eqNullSafe(F.col("l.__lang")), "left")
    kept = ~F.col("base_failed")
    for k, v in ratios.items():
        most, least = (F.coalesce(F.col(f"own.{k}_{x}"), F.col(f"by_lang.{k}_{x}"), F.lit(bounds[f"{k}_{x}"])) for x in ("most", "least"))
        kept = kept & (v <= most) & (v >= least)
    return joined.select(F.col(f"s.{id_col}").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
