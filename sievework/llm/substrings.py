"""Operator 3: removal of repeated word windows by difference-cover anchors.

Residues 0, 1, 3 and 9 modulo 13 form a difference cover: for any two positions
some shift below 13 brings both to such residues. So two equal windows of 20 words
hold, at the same shift, equal anchors of 8 words that start at covered positions.

1. Hash the anchors at covered positions and deal them by hash; those met twice are live.
2. Extend: hash, in full, only windows around live anchors, and deal them by hash. The
   earliest place of each window stays; all others are later repeats.
3. Bring the later places back to their documents and drop the words they cover. Only texts that may have such places cross a shuffle.

A task first merges what its own documents share: one row per hash and block of text
goes on, so a passage that a third of all documents hold makes no large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BLOB_SCHEMA, pack, rows_of_blobs, slices, starts, unpack
from .common import buckets as bucket_count
from .common import column, drop, marked, stored

PERIOD, COVER = 13, (0, 1, 3, 9)
#: Stands for a null id; the key tells it from a real one.
_NULL = 0


def _words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words of a text joined by single spaces, and where each begins and ends."""
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def covered(n: int, anchor: int) -> np.ndarray:
    """Positions of anchors in a text of ``n`` words."""
    residues = np.zeros(PERIOD, bool)
    residues[list(COVER)] = True
    return np.flatnonzero(np.resize(residues, max(0, n - anchor + 1)))


class Block:
    """Documents of one task, gathered up to a number of bytes."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.keys: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, id_: int, key: int, size: int, at: np.ndarray, *hashes: np.ndarray) -> None:
        doc = np.full(len(at), len(self.ids), np.uint16)
        self.ids.append(id_)
        self.keys.append(key)
        self.parts.append((doc, at.astype(np.uint32), *hashes))
        self.bytes += size

    def full(self, most: int) -> bool:
        return self.bytes >= most or len(self.ids) >= 65_000

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts)]


def _by_document(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows of kind 1: places, in the bucket of their document."""
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ keys.astype(np.uint64)
    bucket = ((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [(b, 1, pack(ids[o], keys[o], at[o])) for b, o in ((b, order[s]) for b, s in slices(bucket[order]))]


def _dealt(bucket: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, *rest: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of kind 0: the records of each bucket with a table of the documents they name."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, rest = bucket[order], doc[order], [r[order] for r in rest]
    out = []
    for b, s in slices(bucket):
        named, local = np.unique(doc[s], return_inverse=True)
        out.append((b, 0, pack(ids[named], keys[named], local.astype(np.uint16), *(r[s] for r in rest))))
    return out


def _lists(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document: id, key, list of places."""
    order = np.lexsort((at, keys, ids))
    ids, keys, at = ids[order], keys[order], at[order].astype(np.int32)
    first = np.flatnonzero(starts(ids, keys)) if len(ids) else np.zeros(0, np.int64)
    for a in range(0, len(first), 20_000):
        f = first[a : a + 20_000]
        end = first[a + 20_000] if a + 20_000 < len(first) else len(ids)
        places = pa.ListArray.from_arrays(pa.array(np.append(f, end) - f[0], pa.int32()), pa.array(at[f[0] : end]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[f]), pa.array(keys[f]), places], names=["id", "key", "at"])


_LISTS = "id long, key long, at array<int>"


def _joined(parts: list[list[np.ndarray]], *kinds: str) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]


def _found(rows: Iterator[pa.RecordBatch], buckets: int, pick: Callable[..., np.ndarray], *kinds: str) -> Iterator[pa.RecordBatch]:
    """Pass rows of kind 1 on; of the records of kind 0 send those that ``pick`` chooses to their documents."""
    records: list[list[np.ndarray]] = []
    for batch in rows:
        out = []
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if kind:
                out.append((bucket, 1, data))
            else:
                ids, keys, local, *rest = unpack(data, "<i8", "<i8", "<u2", *kinds)
                records.append([ids[local], keys[local], *rest])
        yield rows_of_blobs(out)
    ids, keys, at, *rest = _joined(records, "<i8", "<i8", *kinds)
    chosen = pick(ids, keys, at, *rest)
    yield rows_of_blobs(_by_document(ids[chosen], keys[chosen], at[chosen], buckets))


def _gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each document from rows of kind 1."""
    parts = [unpack(data, "<i8", "<i8", "<u4") for batch in rows for data in batch.column(2).to_pylist()]
    yield from _lists(*_joined(parts, "<i8", "<i8", "<u4"))


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    anchor = window - PERIOD + 1
    hash_ = xxhash.xxh3_64_intdigest

    def flush(block: Block) -> pa.RecordBatch:
        ids, keys = np.array(block.ids, np.int64), np.array(block.keys, np.int64)
        doc, at, h = block.arrays()
        order = np.argsort(h, kind="stable")
        doc, at, h = doc[order], at[order], h[order]
        new = starts(h)
        group = np.cumsum(new) - 1
        shared = (np.bincount(group) > 1)[group]
        rows = _by_document(ids[doc[shared]], keys[doc[shared]], at[shared], buckets)
        doc, at, h, shared = doc[new], at[new], h[new], shared[new]
        high = h >> np.uint64(16)
        rows += _dealt((h % np.uint64(buckets)).astype(np.int64), ids, keys, doc, at, (high >> np.uint64(16)).astype(np.uint32), (high & np.uint64(0xFFFF)).astype(np.uint16), shared.astype(np.uint8))
        return rows_of_blobs(rows)

    block = Block()
    for batch in batches:
        for id_, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            if not text:
                continue
            joined, begin, end = _words(text.encode())
            if len(begin) < window:
                continue
            at = covered(len(begin), anchor)
            h = np.array([hash_(joined[a:b]) for a, b in zip(begin[at].tolist(), end[at + anchor - 1].tolist())], np.uint64)
            block.add(id_, key, len(joined), at, h)
            if block.full(block_bytes):
                yield flush(block)
                block = Block()
    if block.ids:
        yield flush(block)


def _live(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, high: np.ndarray, low: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Anchors that are met twice, but for those whose block knows already."""
    h = (high.astype(np.uint64) << np.uint64(16)) | low
    order = np.argsort(h, kind="stable")
    live = np.zeros(len(h), bool)
    if len(h):
        group = np.cumsum(starts(h[order])) - 1
        live[order] = (np.bincount(group) > 1)[group]
    return np.flatnonzero(live & (known == 0))


def _later(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by hash and place, where a hash begins in it, and what comes later than the first place of its hash; null ids come last."""
    null = keys & 1
    order = np.lexsort((at, ids, null, g, h))
    ids, null, at = ids[order], null[order], at[order]
    new = starts(h[order], g[order])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(ids) else np.zeros(0, np.int64)
    return order, new, (ids != ids[first]) | (null != null[first]) | (at != at[first])


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest

    def flush(block: Block) -> pa.RecordBatch:
        ids, keys = np.array(block.ids, np.int64), np.array(block.keys, np.int64)
        doc, at, h, g = block.arrays()
        order, new, later = _later(ids[doc], keys[doc], at, h, g)
        doc, at, h, g = doc[order], at[order], h[order], g[order]
        rows = _by_document(ids[doc[later]], keys[doc[later]], at[later], buckets)
        stay = ~later  # the first place, and rows that repeat it
        return rows_of_blobs(rows + _dealt((h[stay] % np.uint64(buckets)).astype(np.int64), ids, keys, doc[stay], at[stay], h[stay], g[stay].astype(np.uint32)))

    block = Block()
    for batch in batches:
        for id_, key, text, live in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            joined, begin, end = _words(text.as_py().encode())
            live = live.values.to_numpy(zero_copy_only=False)
            n = len(begin) - window + 1
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.maximum(0, live - PERIOD + 1), 1)
            np.add.at(edge, np.minimum(n, live + 1), -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]))
            both = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(begin[at].tolist(), end[at + window - 1].tolist())]), "<u8").reshape(-1, 2)
            block.add(id_, key, len(joined), at, both[:, 0], both[:, 1] >> np.uint64(32))
            if block.full(block_bytes):
                yield flush(block)
                block = Block()
    if block.ids:
        yield flush(block)


def _repeats(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    order, _, later = _later(ids, keys, at, h, g)
    return order[later]


def _remove(batches: Iterator[pa.RecordBatch], window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, key, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            words = (text.as_py() or "").encode().split()
            n, ranges = len(words), []
            if at.is_valid:
                places = np.unique(at.values.to_numpy(zero_copy_only=False))
                cuts = np.flatnonzero(np.diff(places) > window) + 1
                ranges = [(int(p[0]), int(p[-1]) + window) for p in np.split(places, cuts)]
                kept, last = [], 0
                for a, b in ranges:
                    kept += words[last:a]
                    last = b
                words = kept + words[last:]
            out.append((None if key & 1 else id_, n, n - len(words), b" ".join(words), [{"first": a, "end": b} for a, b in ranges]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=names)


def substring_dedup(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (words left, joined by spaces), removed (ranges first, end).

    Words are runs of characters other than ASCII white space. A window of ``window``
    (at least 20) words is repeated if its words also start at an earlier place: a smaller
    id, or an earlier start in the same document. Null and empty texts have no
    words. Rows that share an id count as one place, so equal starts in them are not
    later than each other; a null id comes after all others, and rows with null ids count
    as one place too. Ids must be integers, or text that casts to them. Other columns are ignored; an empty table gives no rows.
    """
    if window < PERIOD + 7:
        raise ValueError(f"windows have {PERIOD + 7} words at least")
    id_, text = column(id_col).cast("long"), column(text_col)
    rows = df.select(id_.alias("raw"), text.alias("text"))
    n = bucket_count(rows)
    # a row's key: 63 bits of its text, and whether its id is null
    null = F.col("raw").isNull().cast("long")
    docs = rows.select(F.coalesce("raw", F.lit(_NULL)).alias("id"), F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(null).alias("key"), "text")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, F.col("bucket"))

    def places(rows: DataFrame, pick: Callable[..., np.ndarray], *kinds: str) -> DataFrame:
        found = dealt(rows).mapInArrow(lambda b: _found(b, n, pick, *kinds), BLOB_SCHEMA)
        return dealt(found).mapInArrow(_gathered, _LISTS)

    def near(known: DataFrame) -> DataFrame:
        return marked(docs, F.xxhash64("id", "key"), known.select(F.xxhash64("id", "key").alias("k")).distinct())

    live = stored(places(docs.mapInArrow(lambda b: _anchor_rows(b, window, n, block_bytes), BLOB_SCHEMA), _live, "<u4", "<u4", "<u2", "u1"), "live-anchors")
    windows = near(live).where("__near").join(live, ["id", "key"]).select("id", "key", "text", "at").mapInArrow(lambda b: _window_rows(b, window, n, block_bytes), BLOB_SCHEMA)
    later = stored(places(windows, _repeats, "<u4", "<u8", "<u4"), "later-windows")
    drop(live)
    names = [id_col, "n_words", "n_removed", "kept", "removed"]
    schema = f"`{id_col}` long, n_words long, n_removed long, kept string, removed array<struct<first:int,end:int>>"
    placed = near(later)
    changed = placed.where("__near").join(later, ["id", "key"], "left").select("id", "key", "text", "at")
    whole = placed.where("not __near").select("id", "key", "text", F.lit(None).cast("array<int>").alias("at"))
    return whole.unionByName(changed).mapInArrow(lambda b: _remove(b, window, names), schema)
