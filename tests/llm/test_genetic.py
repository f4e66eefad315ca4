"""Genetic packing: all pieces with their checksums, few sequences, and the search's own steps."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sievework.llm.genetic import Evolution, Packings, evolved_sequences, pack_evolved
from sievework.llm.queries import tokenizer_path


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_evolved(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    words = ["alpha", "Beta", "naïve", "日本", "x1", "don't"]
    texts = [None, "", " ", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 10, 60, 200]))) for _ in range(150)), "word " * 127, "word " * 128, "word " * 500]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (5, "other")]
    df = spark.createDataFrame([(i, t, 1, "p", 2, 3) for i, t in docs], "doc_id long, text string, piece int, uid string, `a.b` int, start long").repartition(3)
    path = tokenizer_path("word_bpe_49k.json")
    rows = pack_evolved(df, path, end_id=1, capacity=128).collect()
    full = Tokenizer.from_file(path)
    want = []
    for id_, text in docs:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(id_, i, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for i, s in enumerate(range(0, len(ids), 128))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    assert check_places(rows, 128) <= -(-sum(w[3] for w in want) // 128) + 1
    assert pack_evolved(df.limit(0), path).isEmpty()


@pytest.mark.parametrize("lengths", [[50] * 40 + [30] * 40 + [20] * 40, [51] * 50, [100], [99, 1, 1], list(range(1, 100))])
def test_sequences_over_districts(spark, lengths):
    """Many small districts lose nothing, and come close to the least number of sequences."""
    pieces = spark.createDataFrame([(i * 5, n) for i, n in enumerate(lengths)], "uid long, length int")
    rows = evolved_sequences(pieces, 100, Evolution(district=16, rounds=2)).join(pieces, "uid").collect()
    assert sorted(r.uid for r in rows) == [i * 5 for i in range(len(lengths))]
    n = check_places(rows, 100)
    least = len(lengths) if min(lengths) > 50 else -(-sum(lengths) // 100)
    assert n <= 1.1 * least + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    pack = Packings(rng.integers(1, 60, 300), 100, rng)
    a, b = pack.first(0.3), pack.first(0.3)
    for child in (pack.crossover(a, b), pack.crossover(b, a), pack.mutated(a)):
        fill = pack.fill(child)
        assert fill.max() <= 100 and fill.min() > 0 and fill.sum() == pack.lengths.sum() and len(child) == 300
    whole = {tuple(np.flatnonzero(b == k)) for k in range(b.max() + 1)}
    child = pack.crossover(a, b)
    assert len({tuple(np.flatnonzero(child == k)) for k in range(child.max() + 1)} & whole) >= 10


def test_search_improves_on_best_fit():
    """Thirds and halves that best fit decreasing mixes up; migrated packings are where the search begins."""
    worse = better = 0
    for seed in range(8):
        rng = np.random.default_rng(seed)
        cut = np.sort(rng.integers(1, 100, (40, 2)), axis=1)
        lengths = np.concatenate([cut[:, 0], cut[:, 1] - cut[:, 0], 100 - cut[:, 1]])
        lengths = lengths[lengths > 0]
        pack = Packings(lengths, 100, rng)
        begin = pack.first(0.0)
        best = pack.evolve([], Evolution(generations=150, patience=150))[0]
        assert pack.fitness(best) >= pack.fitness(begin)
        better += pack.fitness(best) > pack.fitness(begin)
        again = pack.evolve([best], Evolution(generations=5))[0]
        worse += pack.fitness(again) < pack.fitness(best)
    assert better >= 6 and not worse
