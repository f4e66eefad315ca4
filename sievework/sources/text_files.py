"""Text files as a data source: read in parts of whole lines, written back file by file.

    register(spark)
    rows = spark.read.format("text_files").option("path", folder).option("suffixes", ".v,.sv").load()
    rewrite(changed, folder)

Files are reached through Arrow's file systems, so a path may be local, or a URI of a store that the driver and all executors see.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, offset long, line binary"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri))


@dataclass
class FileRange(InputPartition):
    """Bytes of one file; a line belongs to the range in which it begins."""

    path: str
    first: int
    end: int


class TextFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.split = int(options.get("splitBytes", 32 << 20))
        self.batch = int(options.get("batchBytes", 1 << 20))
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)

    def partitions(self) -> Sequence[InputPartition]:
        files, base = _opened(self.root)
        found = files.get_file_info(fs.FileSelector(base, recursive=True)) if files.get_file_info(base).type == fs.FileType.Directory else [files.get_file_info(base)]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            if info.type == fs.FileType.File and info.path.endswith(self.suffixes or "") and not posixpath.basename(info.path).startswith((".", "_")):
                name = posixpath.relpath(info.path, base) if info.path != base else posixpath.basename(base)
                out += [FileRange(name, a, min(info.size, a + self.split)) for a in range(0, info.size, self.split)]
        return out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        files, base = _opened(self.root)
        whole = posixpath.join(base, partition.path) if files.get_file_info(base).type == fs.FileType.Directory else base
        with io.BufferedReader(files.open_input_file(whole), 1 << 16) as f:
            at = partition.first
            if at:  # the line that holds the byte before belongs to an earlier range
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            offsets, lines, size = [], [], 0
            while at < partition.end and (line := f.readline()):
                offsets.append(at)
                lines.append(line)
                at += len(line)
                size += len(line) + 64
                if size >= self.batch:
                    yield _batch(partition.path, offsets, lines)
                    offsets, lines, size = [], [], 0
            yield _batch(partition.path, offsets, lines)


def _batch(path: str, offsets: list[int], lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.binary())], names=["path", "offset", "line"])


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[tuple[str, str]]


class TextFilesWriter(DataSourceArrowWriter):
    """A task writes its files beside the old ones under other names; the commit renames them, and puts the old ones back if it fails."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFiles:
        files, base = _opened(self.root)
        names: list[tuple[str, str]] = []
        now, out = None, None
        try:
            for batch in batches:
                for path, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                    if path != now:
                        if out is not None:
                            out.close()
                        if path is None or posixpath.isabs(path) or ".." in path.split("/"):
                            raise ValueError(f"{path!r} is no path within the folder")
                        final = posixpath.join(base, path)
                        files.create_dir(posixpath.dirname(final), recursive=True)
                        part = posixpath.join(posixpath.dirname(final), f".{posixpath.basename(final)}.{uuid.uuid4().hex}.part")
                        names.append((part, final))
                        now, out = path, files.open_output_stream(part)
                    if line:
                        out.write(line)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            _delete(files, [part for part, _ in names])
            raise
        return WrittenFiles(names)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        files, _ = _opened(self.root)
        names = [n for m in messages if m for n in m.names]
        done: list[tuple[str, str | None]] = []
        try:
            finals = [final for _, final in names]
            if len(set(finals)) < len(finals):
                raise ValueError("the rows of a file must come from one task")
            for part, final in names:
                kept = None
                if files.get_file_info(final).type == fs.FileType.File:
                    kept = posixpath.join(posixpath.dirname(final), f".{posixpath.basename(final)}.{self.run}.old")
                    files.move(final, kept)
                done.append((final, kept))
                files.move(part, final)
        except BaseException:
            for final, kept in reversed(done):
                if kept:
                    files.move(kept, final)
                else:
                    _delete(files, [final])
            _delete(files, [part for part, _ in names])
            raise
        _delete(files, [kept for _, kept in done if kept])

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        files, _ = _opened(self.root)
        _delete(files, [part for m in messages if m for part, _ in m.names])


def _delete(files: fs.FileSystem, paths: list[str]) -> None:
    for info in files.get_file_info(paths) if paths else []:
        if info.type == fs.FileType.File:
            files.delete_file(info.path)


class TextFiles(DataSource):
    """(path within the folder, offset in bytes, line with its end) of each line. Names that begin with a dot or an underscore are not read.

    Options: path, suffixes (comma-joined), splitBytes, batchBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TextFilesReader:
        return TextFilesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)


def read_lines(spark: SparkSession, folder: str, suffixes: Sequence[str] = (), split_bytes: int = 32 << 20) -> DataFrame:
    """(path, offset, line) of the files below ``folder``; a file of more than ``split_bytes`` is read by several tasks."""
    register(spark)
    return spark.read.format("text_files").option("path", folder).option("suffixes", ",".join(suffixes)).option("splitBytes", split_bytes).load()


def rewrite(rows: DataFrame, folder: str) -> None:
    """Write each file of ``rows`` (path, offset: any order of its lines, line: bytes or text with its end) back to its place below ``folder``.

    Files that ``rows`` does not name stay. All files change or none: until all tasks have written, the old files stay, and a commit that fails puts them
    back. A file's lines go through one task, sorted and streamed.
    """
    register(rows.sparkSession)
    placed = rows.select("path", F.col("offset").cast("long").alias("offset"), F.col("line").cast("binary").alias("line")).repartition("path").sortWithinPartitions("path", "offset")
    placed.write.format("text_files").option("path", folder).mode("append").save()
