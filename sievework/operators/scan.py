"""Text scanned with a state that runs on over lines: code, strings and comments, and what is marked in them.

A line turns each state that it may begin in into the state in which it ends: a small table. Tables are composed within chunks of
lines and then over the chunks of a path, so the state before a line is a running aggregate and no path is one
task's loop. Lines without a delimiter leave the state as it is and are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODE, BLOCK, LINE, STRING = "code", "block", "line", "string"


@dataclass(frozen=True)
class Syntax:
    """Delimiters: what begins a comment to the line's end, block comments, strings within a line, strings over lines; and the word that marks begin with."""

    line: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: tuple[str, ...] = ('"',)
    long_quotes: tuple[str, ...] = ()
    word: str = "check"

    @property
    def states(self) -> int:
        """0: code, 1: block comment, then one for each kind of string that runs over lines."""
        return 2 + len(self.long_quotes)

    def delimiters(self) -> list[str]:
        found = [*self.long_quotes, *self.quotes, self.line, *(self.block or ())]
        return sorted((d for d in found if d), key=len, reverse=True)


@lru_cache(maxsize=None)
def _patterns(s: Syntax) -> tuple[re.Pattern, dict[str, tuple[str, re.Pattern, int]], list[tuple[str, re.Pattern, int]]]:
    """What begins a part, and for each opener and each state the part's kind, how its content ends, and the state of a line that does not end it."""

    def upto(close: str, escapes: bool) -> re.Pattern:
        return re.compile(("(?:\\\\.|" if escapes else "(?:") + f"(?!{re.escape(close)}).)*({re.escape(close)})?", re.S)

    blocks = {s.block[0]: (BLOCK, upto(s.block[1], False), 1)} if s.block else {}
    longs = {q: (STRING, upto(q, True), 2 + i) for i, q in enumerate(s.long_quotes)}
    openers = {q: (STRING, upto(q, True), 0) for q in s.quotes} | blocks | longs
    begins = [d for d in s.delimiters() if d in openers or d == s.line]
    return re.compile("|".join(map(re.escape, begins)) or r"(?!)"), openers, [*blocks.values(), *longs.values()]


def walk(text: str, state: int, s: Syntax) -> tuple[list[tuple[str, str, bool]], int]:
    """Parts (kind, content without delimiters, whether it ends here) of a line that begins in ``state``, and the state after it."""
    begins, openers, over_lines = _patterns(s)
    parts, at = [], 0
    now = next((x for x in over_lines if x[2] == state), None) if state else None
    while True:
        if now is None:
            m = begins.search(text, at)
            if m is None:
                return [*parts, (CODE, text[at:], True)], 0
            parts.append((CODE, text[at : m.start()], True))
            if m[0] not in openers:
                return [*parts, (LINE, text[m.end() :], True)], 0
            now, at = openers[m[0]], m.end()
        kind, content, over = now
        end = content.match(text, at)
        closed = end[1] is not None
        parts.append((kind, text[at : end.start(1) if closed else len(text)], closed))
        if not closed:
            return parts, over
        now, at = None, end.end()


def running(rows: DataFrame, table: str, n_states: int, name: str, line: str = "line_no", begin: int = 0, chunk: int = 512) -> DataFrame:
    """``rows`` (path, ``line``, ``table``: the state after the row for each state before it) with ``name``: the state before the row.

    A path begins in state ``begin``. A table is an array of ints; the same line must not stand twice in a path.
    """
    extra = [c for c in rows.columns if c not in ("path", line)]
    same = F.array(*map(F.lit, range(n_states)))
    listed = rows.groupBy("path", F.call_function("div", F.col(line), F.lit(chunk)).alias("__chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col(line).alias("__line"), F.struct(*(F.col(f"`{c}`") for c in extra)).alias("__row")))).alias("__rows"))
    whole = listed.withColumn("__table", F.aggregate(F.transform("__rows", lambda r: r["__row"][table]), same, lambda a, t: F.transform(a, lambda x: F.get(t, x))))
    starts = F.struct(F.lit(begin).alias("now"), F.array().cast("array<int>").alias("seen"))
    seen = lambda tables, start: F.aggregate(tables, start, lambda a, t: F.struct(F.get(t, a["now"]).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen")))["seen"]
    over = whole.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("__chunk", "__table"))).alias("c"))
    first = over.select("path", F.inline(F.arrays_zip(F.col("c.__chunk").alias("__chunk"), seen(F.col("c.__table"), starts).alias("__start"))))
    both = listed.join(first, ["path", "__chunk"])
    mine = F.struct(F.col("__start").alias("now"), F.array().cast("array<int>").alias("seen"))
    placed = both.withColumn("__seen", seen(F.transform("__rows", lambda r: r["__row"][table]), mine))
    each = placed.select("path", F.inline(F.arrays_zip("__rows", "__seen")))
    return each.select("path", F.col("__rows.__line").alias(line), *(F.col(f"__rows.__row.`{c}`").alias(c) for c in extra), F.col("__seen").alias(name))


_TABLES = "path {path}, line_no int, table array<int>, marks array<struct<off:boolean,off_codes:array<string>,on:boolean,one:boolean,one_codes:array<string>>>"


def marks_of(parts: list[tuple[str, str, bool]], s: Syntax) -> dict:
    """The marks of a line: ranges are switched by whole block comments, single lines by line comments."""
    word = re.escape(s.word)
    off = on = one = None
    for kind, content, closed in parts:
        if kind == BLOCK and closed:
            off = off or re.match(rf"\s*{word}\s+off\b(.*)$", content, re.S)
            on = on or re.match(rf"\s*{word}\s+on\b", content)
        elif kind == LINE:
            one = one or re.search(rf"^\s*{word}:\s*disable-line\b(.*)$", content)
    codes = lambda m: sorted(set(m[1].split())) or None if m else None
    return {"off": bool(off), "off_codes": codes(off), "on": bool(on), "one": bool(one), "one_codes": codes(one)}


def scanned(rows: DataFrame, s: Syntax = Syntax()) -> DataFrame:
    """(path, line_no, off, off_codes, on, one, one_codes): the marks of lines (path, line_no, raw), each judged by the state that its line begins in."""
    known = F.rlike("raw", F.lit("|".join(map(re.escape, s.delimiters()))))
    path_type = rows.schema["path"].dataType.simpleString()
    kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.struct([("off", pa.bool_()), ("off_codes", pa.list_(pa.string())), ("on", pa.bool_()), ("one", pa.bool_()), ("one_codes", pa.list_(pa.string()))])))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, marks = [], []
            for raw in batch.column(2).to_pylist():
                found = [walk(raw, state, s) for state in range(s.states)]
                ends.append([end for _, end in found])
                marks.append([marks_of(parts, s) for parts, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kinds[0]), pa.array(ends, kinds[1]), pa.array(marks, kinds[2])], names=["path", "line_no", "table", "marks"])

    looked = rows.where(known).select("path", F.col("line_no").cast("int"), "raw").mapInArrow(tables, _TABLES.format(path=path_type))
    placed = running(looked, "table", s.states, "state").withColumn("m", F.get("marks", "state"))
    return placed.where("m.off or m.on or m.one").select("path", "line_no", "m.*")


def suppressions(marks: DataFrame) -> DataFrame:
    """(path, first, end, codes) from ``scanned`` marks: where findings are silenced, those of ``codes`` or (null) all; end is not within, null runs on.

    The first 'off' opens a range and the next 'on' closes it; a line that has both closes an open range, or opens one. What else such a
    line says is not looked at. A line of its own that names no codes adds nothing inside a range.
    """
    table = F.array(F.when(F.col("off"), 1).otherwise(0), F.when(F.col("on"), 0).otherwise(1))
    placed = running(marks.withColumn("table", table), "table", 2, "within")
    changed = placed.withColumn("next", F.get("table", "within")).where("within <> next")
    by = Window.partitionBy("path").orderBy("line_no")
    ranges = changed.withColumn("end", F.lead("line_no").over(by)).where("next = 1").select("path", F.col("line_no").alias("first"), "end", F.col("off_codes").alias("codes"))
    single = placed.where("one and within = get(table, within)")
    inside = (F.col("within") == 1) & F.col("one_codes").isNull()
    return ranges.unionByName(single.where(~inside).select("path", F.col("line_no").alias("first"), (F.col("line_no") + 1).alias("end"), F.col("one_codes").alias("codes")))
