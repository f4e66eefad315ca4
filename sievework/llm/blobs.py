"""Arrays as binary columns: many small records cross a shuffle in one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], "<i8")
    return b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)])


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def planes(a: np.ndarray) -> np.ndarray:
    """The lowest bytes of all numbers, then the next ones, and so on: the high bytes, which are mostly equal, then compress to nothing."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.ravel()


def from_planes(data: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeezed(a: np.ndarray) -> np.ndarray:
    """The planes of ``a`` by zstd: a shuffle's own LZ4 shortens repeats only, not numbers of a small range."""
    return np.frombuffer(_ZSTD.compress(planes(a).tobytes(), asbytes=True), np.uint8)


def unsqueezed(data: np.ndarray, kind: str, length: int) -> np.ndarray:
    size = length * np.dtype(kind).itemsize
    return from_planes(np.frombuffer(_ZSTD.decompress(data.tobytes(), size, asbytes=True), np.uint8), kind)


def records(*arrays: np.ndarray) -> np.ndarray:
    """Arrays of one length side by side, as a matrix of bytes."""
    return np.concatenate([np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize) for a in arrays], axis=1)


def squeezed_records(rows: np.ndarray, tail: np.ndarray = np.zeros(0, np.uint8)) -> bytes:
    """Rows of ``records``, byte by byte of all rows, and more bytes after them, as one value by zstd."""
    return len(rows).to_bytes(8, "little") + len(tail).to_bytes(8, "little") + _ZSTD.compress(rows.T.tobytes() + tail.tobytes(), asbytes=True)


def unsqueezed_records(values: list[bytes], *kinds: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """How many rows each value has, the arrays over all values, and the joined tails."""
    widths = [np.dtype(k).itemsize for k in kinds]
    sizes, parts, tails = [], [], []
    for v in values:
        n, more = int.from_bytes(v[:8], "little"), int.from_bytes(v[8:16], "little")
        whole = np.frombuffer(_ZSTD.decompress(v[16:], n * sum(widths) + more, asbytes=True), np.uint8)
        sizes.append(n)
        parts.append(whole[: len(whole) - more].reshape(sum(widths), n))
        tails.append(whole[len(whole) - more :])
    joined = np.concatenate(parts, axis=1)
    parts.clear()
    ends = np.cumsum(widths).tolist()
    return np.array(sizes), [np.ascontiguousarray(joined[e - w : e].T).view(k).ravel() for e, w, k in zip(ends, widths, kinds)], np.concatenate(tails)


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of each run of equal keys."""
    if len(sorted_keys):
        cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)]):
            yield int(sorted_keys[a]), slice(a, b)


def starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def rows_of_blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows for a shuffle: the bucket they go to, their kind, their arrays."""
    bucket, kind, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


BLOB_SCHEMA = "bucket int, kind int, data binary"
