"""Operator 4: token counts of whole texts by batch encoding in Arrow functions.

A text is cut at boundaries that no token of a byte-level vocabulary with the
usual splitting pattern can cross: between a character that is no white space and
a white-space character. Each piece is encoded once per worker and batch of
pieces (batches are balanced by bytes); only lengths are kept. Long pieces, from texts without
white space, are cut again where the library's splitting has a boundary.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, kept_in_worker

#: White space as the splitting pattern's \s sees it.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


#: Words of more characters are not remembered.
LONG = 64


def pieces(text: str) -> list[str]:
    """Cut ``text`` before each white-space run that follows another character."""
    return _PIECE.findall(text)


class PieceCounter:
    """Counts tokens. The lengths of short pieces are remembered, within ``remembered_bytes``; longer ones only for a batch.

    A piece of more than ``longest`` characters (text without white space) is cut where the library's own
    splitting ends a part (special strings are parts of their own), but not at the last few parts of what was shown to it, which
    more text could change. A part that is longer itself is encoded whole.
    """

    def __init__(self, path: str, batch_bytes: int = 1 << 20, remembered_bytes: int = 48 << 20, longest: int = 1 << 14):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = [t.content for t in special if t.lstrip or t.rstrip or t.single_word]  # what stands around these matters
        self.special = re.compile("|".join(sorted((re.escape(t.content) for t in special), key=len, reverse=True)) or r"(?!)")
        self.batch_bytes, self.remembered_bytes, self.longest = batch_bytes, remembered_bytes, longest
        self.known: dict[str, int] = {}
        self.bytes = 0

    def _split(self, piece: str) -> list[str]:
        if len(piece) <= self.longest or any(x in piece for x in self.whole):
            return [piece]
        out, last = [], 0
        for m in self.special.finditer(piece):
            out += [*self._split_plain(piece[last : m.start()]), m[0]]
            last = m.end()
        return out + self._split_plain(piece[last:])

    def _split_plain(self, piece: str) -> list[str]:
        """Parts of a text without special strings."""
        out, begin, size = [], 0, self.longest
        while len(piece) - begin > size:
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece[begin : begin + size])
            cut = parts[-4][1][0] if len(parts) > 4 else 0
            if cut:
                out.append(piece[begin : begin + cut])
                begin, size = begin + cut, self.longest
            else:
                size *= 2
        return [*out, piece[begin:]] if begin < len(piece) else out

    def _learn(self, new: set[str]) -> None:
        batch, size = [], 0
        for piece in new:
            batch.append(piece)
            size += len(piece.encode())
            self.bytes += 4 * len(piece) + 160
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        if batch:
            found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, found)))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) for t in texts]
        cut = [[y for x in p for y in self._split(x)] if max(map(len, p), default=0) > self.longest else p for p in cut]
        new = set().union(*cut).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        out = [sum(map(get, p)) for p in cut]
        for piece in new:
            if len(piece) > LONG:
                del self.known[piece]
        if self.bytes > self.remembered_bytes:
            self.known.clear()
            self.bytes = 0
        return out


def _counter(path: str) -> PieceCounter:
    return kept_in_worker("tokens", path, lambda: PieceCounter(path))


def balanced(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes in bytes, with about ``most`` bytes each."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512, batch_bytes: int = 4 << 20) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` to the columns of ``df`` but the text.

    Every row gives one row. A null text counts as empty (0 bytes, 0 tokens);
    repeated rows are counted each on their own; other columns pass unchanged,
    but for columns of the three new names, which are replaced. An empty table gives
    an empty result.
    """
    kept = [c for c in df.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    numbers = [f"c{i}" for i in range(len(kept))]  # names of the columns cannot clash
    source = df.select(*map(column, kept), F.coalesce(column(text_col), F.lit(""))).toDF(*numbers, "text")
    schema = source.drop("text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = column.to_pylist()
            n, sizes = [], [len(t.encode()) for t in texts]
            for a, b in balanced(sizes, batch_bytes):
                n.extend(counter.counts(texts[a:b]))
            n_bytes = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(count, schema).toDF(*kept, "n_bytes", "n_tokens", "over_limit")
