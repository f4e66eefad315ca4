"""Streams of source snapshots: line checks as files arrive, the last text per path, event-time tallies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import TAIL, raw_line, without_tail
from ..operators import lines


def arriving(spark: SparkSession, folder: str, schema: str = "path string, text string, ts timestamp") -> DataFrame:
    """Snapshots (path, text, ts) from Parquet files as they are added to a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def style_stream(snapshots: DataFrame, most: int = 100) -> DataFrame:
    """Style diagnostics of every arriving text; stateless, so each batch is independent."""
    return lines.style(lines.lines(snapshots, "path", "text"), most)


def distinct_snapshots(snapshots: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Snapshots whose text has not been seen for the same path within the watermark."""
    return snapshots.withColumn("digest", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path", "digest"])


def edits_per_window(snapshots: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, path, edits): distinct texts per path and event-time window; late rows beyond the delay are left out."""
    counted = snapshots.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "path").agg(F.size(F.collect_set(F.sha2("text", 256))).alias("edits"))
    return counted.select(F.col("w.start").alias("start"), "path", "edits")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write it as Parquet, and stop; the checkpoint makes a second run go on from there."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


_HELD = "hashes array<bigint>, codes array<string>, lines array<int>, seen long"
_CHANGES = "path string, ts timestamp, first int, old_end int, new_end int, came array<struct<code:string,line_no:int>>, gone array<struct<code:string,line_no:int>>"


def _compared(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None) -> Iterator[pd.DataFrame]:
    """The changes of one path's snapshots against the state, which keeps hashes of the last one's lines, its findings and its time."""
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
    hashes, codes, places, seen = state.get if state.exists else ([], [], [], None)
    hashes = [int(x) for x in hashes]
    found = [(c, int(i), hashes[i]) for c, i in zip(codes, places)]
    out = []
    for at, ts, now, codes, places in zip(new["at"], new["ts"], new["hashes"], new["codes"], new["lines"]):
        if seen is not None and at < seen:
            continue  # late: the state is newer
        now = [int(x) for x in now]
        marks = [(c, int(i), now[i]) for c, i in zip(codes, places)]
        if now != hashes or marks != found:
            out.append(_change(key[0], ts, hashes, now, found, marks))
        hashes, found, seen = now, marks, int(at)
    state.update((hashes, [c for c, _, _ in found], [i for _, i, _ in found], seen))
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
    yield pd.DataFrame(out, columns=["path", "ts", "first", "old_end", "new_end", "came", "gone"])


def _change(path: str, ts: pd.Timestamp, old: list[int], new: list[int], found: list[tuple], marks: list[tuple]) -> tuple:
    """The lines between the common head and tail, and the findings that one side has more often, by code and line text."""
    n = min(len(old), len(new))
    head = next((i for i in range(n) if old[i] != new[i]), n)
    tail = next((i for i in range(n - head) if old[-1 - i] != new[-1 - i]), n - head)
    spare = Counter((code, h) for code, _, h in found)
    came = []
    for code, line, h in marks:
        if spare[code, h]:
            spare[code, h] -= 1
        else:
            came.append({"code": code, "line_no": line})
    spare = Counter((code, h) for code, _, h in marks)
    gone = []
    for code, line, h in found:
        if spare[code, h]:
            spare[code, h] -= 1
        else:
            gone.append({"code": code, "line_no": line})
    return path, ts, head, len(old) - tail, len(new) - tail, came, gone


def snapshot_changes(snapshots: DataFrame, most: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """(path, ts, first, old_end, new_end, came, gone) whenever a path's text differs from its last one: the damaged lines, and the style findings that came or went.

    ``snapshots``: path, text, ts. The first snapshot of a path is all new. Within a batch a path's snapshots are taken by ts (equal ones by their text's hash); one that is older than the state
    is left out. Only hashes of lines and findings are kept and cross a shuffle, never texts; a path without a snapshot for ``ttl_ms`` is forgotten. Null texts are empty texts.
    """
    text = F.coalesce("text", F.lit(""))
    raw = F.transform(F.split(text, "\n", -1), raw_line)
    size = lambda x: F.length(x)
    checks = {
        "ST001": lambda x: F.rlike(x, F.lit(TAIL)),
        "ST002": lambda x: F.instr(without_tail(x), "\t") > 0,
        "ST003": lambda x: size(x) > most if most else F.lit(False),
    }
    mark = lambda x, i: F.array_compact(F.array(*(F.when(test(x), F.struct(F.lit(code).alias("code"), i.alias("line_no"))) for code, test in checks.items())))
    found = F.flatten(F.transform(raw, mark))
    rows = snapshots.select("path", "ts", F.unix_micros("ts").alias("at"), F.transform(raw, lambda x: F.xxhash64(x)).alias("hashes"), found.alias("found"), F.xxhash64(text).alias("tie"))
    rows = rows.select("path", "ts", "at", "hashes", "tie", F.col("found.code").alias("codes"), F.col("found.line_no").alias("lines"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("path").applyInPandasWithState(lambda key, batches, state: _compared(key, batches, state, ttl_ms), _CHANGES, _HELD, "append", timeout)
