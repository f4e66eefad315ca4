"""Each pipeline stage against brute force, on its own input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import quality
from sievework.llm.queries import tokenizer_path
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(14)) for i in range(6)]
    shared = text(20) + "\n" + text(20)
    docs, labels = [], []
    for i in range(420):
        kind = rng.choice(["good"] * 6 + ["junk", "toxic"])
        body = "\n".join(text(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 5)))
        if kind == "junk":
            body = body.upper().replace(" ", "## ")
        elif kind == "toxic":
            body = body.replace(" ", " vile ", 3)
        elif i % 9 == 0:
            body += "\n" + shared
        elif i % 10 == 0:
            body += " " + items[i % 6][1]
        docs.append((i, body, "en", "s", len(body)))
        labels.append((i, 0 if kind == "junk" else 1, int(kind == "toxic")))
    for i in range(420, 450):  # near and exact copies of good documents, in other lines
        body = docs[rng.choice([d for d, q, t in labels if q and not t])][1].replace("\n", " ")
        docs.append((i, body + (" more" if i % 2 else ""), "en", "s", len(body)))
    docs += [(450, None, None, None, None), (451, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, path).write.parquet(out)
        after = spark.read.parquet(out)
        pairs = [(i, r.text) for i, r in before.items()] if k < 5 else None
        if k < 4:
            assert after.columns == columns, name
            got = {r.doc_id: r for r in after.collect()}
        if k == 0:
            model = quality.learn(docs, quality.grades_of_labels(spark.read.parquet(f"{path}/labels.parquet")), 3)
            make = quality.Features(quality.Fit().bits)
            score = {i: model.weights[make.of(t or "")].sum(dtype=np.float64) for i, t in pairs}
            want = {i for i, t in pairs if (t or "").strip() and 1 - model.at_most(np.array([score[i]]))[0, 1] >= 0.65}
            assert set(got) == want and len(want) < len(pairs)
        elif k == 1:
            want = {i: t for i, t, _, _ in brute.line_dedup(pairs) if brute.SPACE_WORD.search(t or "")}
            assert {i: r.text for i, r in got.items()} == want
            assert all(r.n_chars == len(r.text) for r in got.values()) and any(want[i] != before[i].text for i in want)
        elif k == 2:
            want = {i for i, _, c in brute.jaccard_components(pairs) if c == i}
            assert set(got) == want and len(want) < len(pairs)
        elif k == 3:
            want = {r[0] for r in brute.decontaminate(pairs, items) if not r[2]}
            assert set(got) == want and len(want) < len(pairs)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs}
            rows = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
            assert {r.doc_id: (r.n, r.m) for r in rows} == {i: (n, n) for i, n in sizes.items()}
        docs = after
        if k < 4:
            before = got


def test_rows_with_null_and_shared_ids(spark, folder):
    """Rows are told apart by id and text: a hit or a copy takes no other row of its id with it, and a null id saves none."""
    path, items = folder
    rng = random.Random(12)
    text = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(40), text(40), text(40)
    leak = text(5) + " " + items[0][1]
    near = b.rsplit(" ", 1)[0] + " changed"
    rows = [
        (None, items[1][1]), (None, leak), (1, leak), (1, a), (None, a), (2, a), (2, b), (None, b), (5, near), (5, near), (5, near),
        (None, c), (None, c), (7, None), (7, None), (None, None), (8, ""), (8, " "), (9, c + " more"), (9, c + " most"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, component_id string, __x int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", n) for n, (i, t) in enumerate(rows)], schema).repartition(3)
    left = corpus_pipeline.decontamination_stage(spark, docs, path)
    assert left.columns == docs.columns
    same_rows(left, [r for r in rows if r[1] is None or r[1] not in (items[1][1], leak)])
    left = corpus_pipeline.near_duplicate_stage(spark, docs, path)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    one = [x for x in got if x[1] and x[1].startswith(c)]
    assert len(one) == 1 and one[0][0] == 9  # a null id is the largest
    assert [x for x in got if x[1] and not x[1].startswith(c)] == sorted([(None, items[1][1]), (1, leak), (1, a), (2, b), (8, " ")], key=str)
    assert [x for x in got if not x[1]] == sorted([(7, None), (7, None), (None, None), (8, "")], key=str)
    lines = corpus_pipeline.line_stage(spark, spark.createDataFrame([(3, "x y\nz w", 1), (None, "x y\nz w", 1), (None, "x y\nz w\nown line", 1), (3, "x y\nz w", 1), (4, None, 1)], "doc_id long, text string, n_chars long"), path)
    assert sorted(map(tuple, lines.collect()), key=str) == sorted([(3, "x y\nz w", 7), (3, "x y\nz w", 7), (None, "own line", 8)], key=str)
    packed = corpus_pipeline.packing_stage(spark, docs, path)
    assert packed.where("start = 0").count() == len(rows)


def test_columns_of_the_user_pass_each_stage(spark, folder):
    """Names that stages use themselves, names with dots and names of other results: values stay, whatever the stage."""
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = {"kept": "user", "tail_probability": "odd", "__key": "k", "a.b": "dot", "__text": "t", "__near": "n", "__word": "w", "__place": "p", "__marks": "m", "key": "x", "c1": "y", "rest": "r", "row": "z"}
    wide = docs.select("*", *(F.concat(F.lit(v), F.col("doc_id").cast("string")).alias(k) for k, v in extra.items())).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:4]:
        want = {r.doc_id for r in stage(spark, docs, path).collect()}
        left = stage(spark, wide, path)
        assert left.columns == wide.columns, name
        rows = left.collect()
        assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        assert all(r[k] == f"{v}{r.doc_id}" for r in rows for k, v in extra.items()), name


def same_rows(frame, want):
    assert sorted(((r.doc_id, r.text) for r in frame.collect()), key=str) == sorted(want, key=str)


def test_run(spark, folder):
    """The whole pipeline against the brute-force stages one after another."""
    path, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.learn(docs, quality.grades_of_labels(spark.read.parquet(f"{path}/labels.parquet")), 3)
    make = quality.Features(quality.Fit().bits)
    good = lambda t: (t or "").strip() and 1 - model.at_most(np.array([model.weights[make.of(t)].sum(dtype=np.float64)]))[0, 1] >= 0.65
    pairs = [(r.doc_id, r.text) for r in docs.collect() if good(r.text)]
    pairs = [(i, t) for i, t, _, _ in brute.line_dedup(pairs) if brute.SPACE_WORD.search(t or "")]
    first = {i for i, _, c in brute.jaccard_components(pairs) if c == i}
    pairs = [p for p in pairs if p[0] in first]
    clean = {r[0] for r in brute.decontaminate(pairs, items) if not r[2]}
    pairs = [p for p in pairs if p[0] in clean]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs}
    rows = corpus_pipeline.run(spark, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in rows} == {i: (n, n) for i, n in want.items()}


def test_nothing_to_do(spark, folder, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
