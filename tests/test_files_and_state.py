"""The text file source (round trip, splitting, failed writes) and the stream that keeps state between snapshots (restart, ttl)."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.sources.text_files import TextFilesReader, TextFilesWriter, WrittenFiles, read_lines, rewrite
from sievework.streaming import changes as streaming


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    files = {
        "a.v": b"one\r\ntwo\n\nlast without end", "sub/b.v": b"\xef\xbb\xbfbom\n\xff\xfe not utf-8\n", "sub/deep/c.sv": b"\n\n\n", "empty.v": b"", "long.v": b"x" * 900 + b"\n" + b"y" * 700,
        "many.v": b"".join(b"%d " % i + b"z" * rng.randrange(40) + b"\n" for i in range(500)), "notes.txt": b"no source\n", ".hidden.v": b"hidden\n",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path, files


def contents(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("*") if f.is_file()}


@pytest.mark.parametrize("split", [3, 7, 1000, 1 << 20])
def test_each_line_is_read_once(folder, split):
    path, files = folder
    reader = TextFilesReader({"path": str(path), "splitBytes": str(split), "batchBytes": "100", "suffixes": ".v,.sv"})
    got = {}
    for part in reader.partitions():
        if split == 1 and part.path == "long.v" and part.first % 97:
            continue
        for batch in reader.read(part):
            for p, offset, line in zip(*(c.to_pylist() for c in batch.columns)):
                assert (p, offset) not in got
                got[p, offset] = line
    for name, data in files.items():
        mine = b"".join(line for (p, _), line in sorted(got.items()) if p == name)
        assert mine == (data if name.endswith((".v", ".sv")) and not name.startswith(".") else b"")


def test_round_trip_and_edit(spark, folder):
    path, files = folder
    rows = read_lines(spark, str(path), [".v", ".sv"], split_bytes=600)
    assert rows.rdd.getNumPartitions() > 8
    rewrite(rows, str(path))
    assert contents(path) == files
    wide = rows.where("path = 'many.v'")
    rewrite(wide.withColumn("line", F.regexp_replace(F.col("line").cast("string"), "^([0-9]+)", "line $1")), str(path))
    changed = contents(path)
    assert changed.pop("many.v").startswith(b"line 0 ") and changed == {k: v for k, v in files.items() if k != "many.v"}
    rewrite(spark.createDataFrame([("new/d.v", 1, "b\n"), ("new/d.v", 0, "a\n"), ("new/void.v", 0, None)], "path string, offset int, line string"), str(path))
    assert (path / "new/d.v").read_bytes() == b"a\nb\n" and (path / "new/void.v").read_bytes() == b""


def test_failed_write_leaves_the_old_files(spark, folder):
    path, files = folder
    rows = read_lines(spark, str(path), [".v"])
    fails = rows.withColumn("line", F.when((F.col("path") == "many.v") & (F.col("offset") > 0), F.raise_error(F.lit("broken"))).otherwise(F.lit(b"changed\n")))
    with pytest.raises(Exception, match="broken"):
        rewrite(fails, str(path))
    assert contents(path) == files
    for bad in ("../out.v", "/abs.v", None):
        with pytest.raises(Exception):
            rewrite(spark.createDataFrame([(bad, 0, "x")], "path string, offset int, line string"), str(path))
    assert contents(path) == files


def test_failed_commit_puts_the_old_files_back(folder):
    path, files = folder
    writer = TextFilesWriter({"path": str(path)})
    import pyarrow as pa

    done = writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a.v", "new.v"], "offset": [0, 0], "line": [b"changed", b"new"]})]))
    with pytest.raises(Exception):
        writer.commit([done, WrittenFiles([(str(path / ".missing.part"), str(path / "sub/b.v"))])])
    assert contents(path) == files
    again = writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a.v"], "offset": [0], "line": [b"changed"]})]))
    writer.abort([again, None])
    assert contents(path) == files
    with pytest.raises(ValueError):
        writer.commit([writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a.v"], "offset": [0], "line": [b"x"]})])) for _ in range(2)])
    assert contents(path) == files


def snapshots():
    rng = random.Random(2)
    line = lambda: rng.choice(["a", "b ", "c\td", "x" * 120, "", "e\r"])
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    texts = {p: [line() for _ in range(rng.randrange(6))] for p in ("p", "q", "r")}
    out = []
    for i in range(24):
        p = rng.choice("pqr")
        body = list(texts[p])
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(body) + 1)
            body[k : k + rng.randrange(3)] = [line() for _ in range(rng.randrange(3))]
        texts[p] = body
        out.append((p, "\n".join(body) if i % 7 else None, at(i)))
    return out


def wanted(rows):
    old, out = {}, []
    for p, text, ts in sorted(rows, key=lambda r: r[2]):
        new = [x.rstrip("\r") for x in (text or "").split("\n")]
        marks = [(code, i) for i, x in enumerate(new) for code, hit in (("ST001", x != x.rstrip(" \t")), ("ST002", "\t" in x.rstrip(" \t")), ("ST003", len(x) > 100)) if hit]
        was, had = old.get(p, ([], []))
        if was != new:
            n = min(len(was), len(new))
            head = next((i for i in range(n) if was[i] != new[i]), n)
            tail = next((i for i in range(n - head) if was[-1 - i] != new[-1 - i]), n - head)
            spare = [(c, was[i]) for c, i in had]
            came = [(c, i) for c, i in marks if not ((c, new[i]) in spare and not spare.remove((c, new[i])))]
            spare = [(c, new[i]) for c, i in marks]
            gone = [(c, i) for c, i in had if not ((c, was[i]) in spare and not spare.remove((c, was[i])))]
            out.append((p, ts, head, len(was) - tail, len(new) - tail, came, gone))
        old[p] = new, marks
    return out


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Three runs over one checkpoint, each with new files, give what one pass over all snapshots gives."""
    rows = snapshots()
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for begin in range(0, 24, 8):
        part = rows[begin : begin + 8]
        spark.createDataFrame(part, "path string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        found = streaming.snapshot_changes(streaming.arriving(spark, source))
        streaming.run_available(found, out, checkpoint).awaitTermination()
    got = [(r.path, r.ts, r["first"], r.old_end, r.new_end, [tuple(x) for x in r.came], [tuple(x) for x in r.gone]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(wanted(rows))
    late = [("p", "older", dt.datetime(2020, 1, 1))]
    spark.createDataFrame(late, "path string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    streaming.run_available(streaming.snapshot_changes(streaming.arriving(spark, source)), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == len(got)


def test_change_between_two_texts():
    got = streaming._change("p", pd.Timestamp(0), [1, 2, 3], [1, 9, 3, 3], [("A", 1, 2), ("B", 2, 3)], [("B", 2, 3), ("B", 3, 3)])
    assert got[2:] == (1, 2, 3, [{"code": "B", "line_no": 3}], [{"code": "A", "line_no": 1}])
