"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import collocations as c
from tests.llm.brute import ASCII_LOWER

DOCS = "doc_id long, text string, lang string, phrase string, n int, `a.b` int, block string"


def brute(docs, longest=4, least=30, most=2000, percent=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in f.items():
        frequent = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        rows = []
        for p, a in frequent.items():
            if covered[p] and 100 * covered[p] >= percent * a:
                continue
            score, _, l, r = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1)]
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = ["a", "B", "b", "É", "é", "日本", "\U0001f600", "c\x00", "x-y", "z\x85z", "longer"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ": "]
    text = lambda m: "".join(rng.choice(words) + rng.choice(sep) for _ in range(m))
    fixed = "one two three four five"
    out = [(text(rng.choice([1, 5, 40])) + rng.choice(["", fixed, "one two three", "two three", "a a a a a a"]), rng.choice(["en", "de", None, "und", ""])) for _ in range(400)]
    return [*out, (None, "en"), ("", "en"), (" .,;", "de"), ("b " * 5000, "en"), out[0], out[0], ("q " * 30, "fr"), ("r s, " * 29 + "r s", "fr"), ("t u " * 29, "fr")]


def frame(spark, docs):
    return spark.createDataFrame([(7, t, lang, "p", 1, 2, "b") for t, lang in docs], DOCS).repartition(3)


def test_collocations(spark, docs):
    want = brute(docs)
    got = c.collocations(frame(spark, docs))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({x[0] for x in want}) >= 5
    small = c.collocations(frame(spark, docs), longest=3, least=5, most=20, cover_percent=50, block_bytes=300)
    assert sorted(map(tuple, small.collect())) == sorted(brute(docs, 3, 5, 20, 50))
    assert c.collocations(frame(spark, [])).isEmpty()
    assert c.collocations(frame(spark, [(None, None), ("", "en")])).isEmpty()


def test_long_text_in_chunks(monkeypatch):
    """Chunks of a long text, with and without ends of pieces, give the codes of the whole."""
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", "c", "dé", "."]) + rng.choice(["", " ", " ", "."]) for _ in range(3000)) + "x" * 500 + " y"
    whole = c.Block()
    whole.add(text)
    monkeypatch.setattr(c, "_CHUNK", 64)
    cut = c.Block()
    cut.add(text)
    for a, b in zip(whole.arrays(), cut.arrays()):
        assert list(a) == list(b)


def test_exact_score_beyond_64_bits(spark):
    """Counts of which 2,000,000 times is over 64 bits."""
    phrases = spark.createDataFrame([("en", "a", 1, 9 * 10**17), ("en", "b", 1, 8 * 10**17), ("en", "a b", 2, 7 * 10**17)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**18)], "lang string, n long")
    got = c.ranked_phrases(phrases, totals).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 7 * 10**17, 9 * 10**17, 8 * 10**17, 10**18, 2_000_000 * 7 // 17)]


def test_extension_is_a_merge_of_positions():
    at = np.array([0, 1, 2, 5, 6])
    places, codes, words = c.extended(at, np.array([7, 8, 9, 7, 8]), at, np.array([0, 1, 2, 0, 1]), 1)
    assert places.tolist() == [0, 1, 5] and codes.tolist() == [7, 8, 7] and words.tolist() == [1, 2, 1]


def test_no_row_holds_a_block(spark, monkeypatch):
    """What Spark stores and shuffles of a block of 300,000 words comes in rows of bounded size, and no row grows with the block."""
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(1000)}" for _ in range(30_000))
    largest = {}

    def stored(df, name, *a, **k):
        out = keep(df, name, *a, **k)
        size = lambda x, kind: F.length(x) if kind in ("binary", "string") else F.size(x) * 4 if kind.startswith("array") else F.lit(8)
        largest[name] = out.agg(F.max(sum((F.coalesce(size(F.col(c), kind), F.lit(0)) for c, kind in out.dtypes), F.lit(0))).alias("n")).first().n or 0
        return out

    keep = c.stored
    monkeypatch.setattr(c, "stored", stored)
    docs = spark.createDataFrame([(text(), "en") for _ in range(10)], "text string, lang string").coalesce(1)
    phrases, totals = c.frequent_phrases(docs, longest=2)
    assert [tuple(r) for r in totals.collect()] == [("en", 300_000)] and phrases.where("size = 1").count() == 1000
    assert largest["blocks"] < 300_000 and max(largest.values()) < 300_000
