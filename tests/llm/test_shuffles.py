"""How much the near-duplicate join shuffles."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from sievework.llm import blobs, jaccard

from tests.llm import brute


@pytest.mark.parametrize("values, kind", [([], "<i8"), ([-1, 0, 1 << 62, -(1 << 63)], "<i8"), ([0, 7, 1 << 31], "<u4"), ([5], "<i4")])
def test_planes_come_back(values, kind):
    a = np.array(values, kind)
    assert blobs.from_planes(blobs.planes(a), kind).tolist() == values


def test_signatures_take_few_bytes_in_many_buckets():
    """With as many buckets as a large input has, nearly each signature stands beside its document's id, size and tag."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 200))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([7 * i for i in range(300)], pa.int64()), pa.array(texts)], names=["id", "text"])
    rows = pa.Table.from_batches(jaccard._signature_rows(iter([batch]), 512, 4 << 20))
    blob = [d for d, k in zip(rows["data"].to_pylist(), rows["kind"].to_pylist()) if k == 0]
    found = pa.Table.from_batches(jaccard._group_rows(iter(rows.to_batches())))
    assert found.filter(pa.compute.equal(found["kind"], jaccard.DOCUMENT)).num_rows == 300
    n = sum(np.frombuffer(d, "<i8", 5)[4] for d in blob)
    data = b"".join(blob)
    assert n > 10_000 and len(pa.compress(data, "lz4_raw", asbytes=True)) < 10 * n


def test_members_are_counted_in_three_shuffles(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(jaccard, "stored", lambda df, name: plans.append(df) or df)
    monkeypatch.setattr(jaccard, "drop", lambda *tables: None)
    rows = [(s, i, 64) for s in (1, 2, 3) for i in (10, 11, 12)] + [(4, 10, 64), (4, 11, 64), (1, 10, 64), (5, 13, 64), (5, 10, 64)]
    members = spark.createDataFrame(rows, "sig long, id long, tag long")
    component = spark.createDataFrame([(10, 10), (11, 10)], "id long, component long")
    found = jaccard._unsettled(members, component)
    want = {(s, i, 64, c, 3 * 3 + 2 * (i == 10), 3 + (i == 10)) for s in (1, 2, 3) for i, c in ((10, 10), (11, 10), (12, 12))} | {(5, 10, 64, 10, 11, 4)}
    assert {tuple(r) for r in found.select("sig", "id", "tag", "c", "weight", "n").collect()} == want and len(plans) == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?:sig|id)", plans[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])) <= 4  # three of members, one of components


def test_unsettled_texts_are_shuffled_for_hubs_once(spark, monkeypatch):
    """Chains of near copies beside documents with one passage: three comparisons in all, of which one with hubs, find every link."""
    rng = random.Random(9)
    words = [f"c{i}" for i in range(120)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        words[(37 * i) % 120] = f"d{i}"
    passage = " ".join(f"p{i}" for i in range(40))
    docs += [(100 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 9, 12, 40])))) for i in range(150)]
    names, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: names.append(name) or stored(df, name))
    found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, brute.jaccard_components(docs)))
    assert "clusters" in names and names.count("compared") == 3 and names.count("unsettled") == 1


def test_words_are_hashed_once_a_batch():
    looked_up = []

    class Counted(jaccard.WordHashes):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    texts = [None, "", " \t", "A b\x0bA", "\na é b É\x85 ", "b " * 50]
    known = Counted()
    got = jaccard.word_hashes(pa.array(texts), known)
    want = [[xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().lower().split()] for t in texts]
    assert [x.tolist() for x in got] == want and len(looked_up) == len(set(looked_up))


@pytest.mark.parametrize("values, kind", [([], "<i8"), ([-1, 0, 1 << 62, -(1 << 63)], "<i8"), ([0, 7, 1 << 31], "<u4"), ([5], "<i4")])
def test_squeezed_numbers_come_back(values, kind):
    a = np.array(values, kind)
    assert blobs.unsqueezed(blobs.squeezed(a), kind, len(a)).tolist() == values


def test_texts_are_read_once_for_a_comparison(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(8)], "id long, text string").write.parquet(str(tmp_path / "docs"))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (4, 5)], "hub long, id long")
    plans, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: plans.append((name, df)) or stored(df, name))
    found = jaccard._against_hubs(pairs, spark.read.parquet(str(tmp_path / "docs")), 4)
    assert {(r.hub, r.id, r.linked) for r in found.collect()} == {(0, 1, True), (0, 2, False), (4, 5, True)}
    plan = dict(plans)["compared"]._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[id#\d+L,text#\d+\] parquet", plan)) == 1


def test_elements_of_differences_are_shuffled_as_three_numbers(spark, monkeypatch):
    """Chains of near copies and of documents with one passage: only row, component and element cross the window's shuffle."""
    compared = spark.createDataFrame([(i, 0, 10 + i, 0, 100, 4, False, [i // 2, 1000 + i, 2000, 3000 + i]) for i in range(6)], jaccard._COMPARED)
    component = spark.createDataFrame([(10, 10), (11, 10)], "id long, component long")
    plans, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: plans.append((name, df)) or stored(df, name))
    found = {(r.hub, r.id) for r in jaccard._near_hubs(compared, component).collect()}
    assert {(i, j) for i in range(10, 16) for j in range(i + 1, 16)} - {(10, 11)} == found  # all differ from the hub in next to nothing
    plan = dict(plans)["heads"]._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):].split("\n")[1]
    assert len(re.findall(r"#\d+L?", window.split("AS h#")[0])) <= 4 and "Project [row#" in window
