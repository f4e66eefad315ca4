"""Operator 8: quality classifier, an ordinal cumulative-link regression on hashed text.

One score per document (a shared weight for each hashed feature: the distinct words
of the whole text, their beginnings, those that repeat, and binned shares such as capitals, symbols and repeats) and
ordered thresholds: P(grade <= j) = sigmoid(threshold_j - score). Selection uses the tail
probability of the wanted grade. The fit is in numpy on a bounded sample.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, column, tidy

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#*$%&|<>~^{}[]@\\_="
_STOPS = b"!?"


@dataclass(frozen=True)
class Fit:
    """rows: bound of the sample. bits: of the hashed space. least_docs: sample documents that a feature
    needs. least_z: standard errors by which their share of grades over some threshold must
    differ from that of all (fewer, down to 3, in small samples).
    """

    rows: int = 20_000
    bits: int = 18
    least_docs: int = 5
    least_z: float = 8.0
    steps: int = 400
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 7


class Features:
    """Hashed features of texts; hashes of short words are remembered, within ``remembered_bytes``."""

    def __init__(self, bits: int, remembered_bytes: int = 40 << 20, longest: int = 64):
        self.mask, self.remembered_bytes, self.longest = (1 << bits) - 1, remembered_bytes, longest
        self.known: dict[bytes, int] = {}
        self.bytes = 0

    def _hash(self, x: bytes) -> int:
        return xxhash.xxh3_64_intdigest(x) & self.mask

    def of(self, text: str) -> np.ndarray:
        """Distinct features of a text; none without words."""
        data = text.encode()
        words = data.translate(FOLD).split()
        if not words:
            return np.zeros(0, np.int64)
        counts = Counter(words)
        distinct = {*counts, *(w + b" 2" for w, k in counts.items() if k > 1), *(w[:5] + b"~" for w in counts if len(w) > 5)}
        if new := distinct.difference(self.known):
            self.known.update((w, self._hash(w)) for w in new)
            self.bytes += sum(map(len, new)) + 160 * len(new)
        hashed = [*map(self.known.__getitem__, distinct)]
        if new:
            for w in [w for w in new if len(w) > self.longest]:
                del self.known[w]
            if self.bytes > self.remembered_bytes:
                self.known.clear()
                self.bytes = 0
        size, n = max(1, len(data)), len(words)
        share = lambda chars: (size - len(data.translate(None, chars))) / size
        shares = {
            "capitals": share(_CAPITALS), "symbols": share(_SYMBOLS), "stops": share(_STOPS),
            "twins": sum(map(operator.eq, words, words[1:])) / n, "distinct": len(counts) / n,
            "breaks": data.count(b"\n") / n,
        }
        binned = [self._hash(f"{k} {int(round(min(1.0, v) ** 0.5 * 12))}".encode()) for k, v in shares.items()]
        return np.unique(np.array([*hashed, *binned], np.int64))


@dataclass
class Ordinal:
    """weights: per hashed feature. thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j) for all grades but the last, by row."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -30, 30)))


def _selected(index: np.ndarray, doc: np.ndarray, grades: np.ndarray, n_grades: int, f: Fit) -> np.ndarray:
    """Which of the hashed features get a weight."""
    size = 1 << f.bits
    by_grade = np.zeros(size * n_grades, np.int64)
    for i in range(0, len(index), 1 << 20):
        s = slice(i, i + (1 << 20))
        by_grade += np.bincount(index[s].astype(np.int64) * n_grades + grades[doc[s]], minlength=len(by_grade))
    by_grade = by_grade.reshape(size, n_grades)
    docs = by_grade.sum(1)
    z = min(f.least_z, max(3.0, 0.065 * len(grades) ** 0.5))
    used = np.zeros(size, bool)
    for j in range(n_grades - 1):
        over = (grades > j).astype(float)
        gap = np.abs(by_grade[:, j + 1 :].sum(1) - docs * over.mean())
        used |= (docs >= f.least_docs) & (gap >= z * np.sqrt(docs) * max(over.std(), 1e-9))
    return used


def fit_ordinal(index: np.ndarray, doc: np.ndarray, grades: np.ndarray, n_grades: int, f: Fit) -> Ordinal:
    """Maximum likelihood with weight decay, by moment-adapted gradient steps over the whole sample.

    index, doc: each feature of each document and the document's place in ``grades``.
    """
    size = 1 << f.bits
    chosen = _selected(index, doc, grades, n_grades, f)[index]
    index, doc = index[chosen].astype(np.int64), doc[chosen].astype(np.int64)
    share = np.bincount(grades, minlength=n_grades).astype(float)
    weight = (1 / np.maximum(share, 1))[grades] ** 0.5
    weight /= weight.mean()
    below = np.clip(np.cumsum(share)[:-1] / share.sum(), 1e-3, 1 - 1e-3)
    theta = np.log(below / (1 - below))
    base, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))
    w = np.zeros(size)
    first = {"w": np.zeros(size), "b": 0.0, "g": np.zeros(len(gaps))}
    second = {"w": np.zeros(size), "b": 0.0, "g": np.zeros(len(gaps))}
    n = len(grades)
    for step in range(1, f.steps + 1):
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(doc, w[index], minlength=n)
        c = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -30, 30)))
        full = np.concatenate([np.zeros((n, 1)), c, np.ones((n, 1))], 1)
        slope = full * (1 - full)
        at = np.arange(n)
        p = np.maximum(full[at, grades + 1] - full[at, grades], 1e-9)
        up, down = slope[at, grades + 1] / p * weight / n, slope[at, grades] / p * weight / n
        d_score = up - down  # of the negative log-likelihood
        d_theta = np.zeros(n_grades + 1)
        np.add.at(d_theta, grades + 1, -up)
        np.add.at(d_theta, grades, down)
        d_theta = d_theta[1:-1]
        g_w = np.bincount(index, d_score[doc], minlength=size) + f.decay * w
        g_b = d_theta.sum()
        g_g = np.array([d_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
        rate, move = f.rate * (1 - (step - 1) / f.steps), {}
        for k, g in (("w", g_w), ("b", g_b), ("g", g_g)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            move[k] = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
        w, base, gaps = w - move["w"], base - move["b"], gaps - move["g"]
    return Ordinal(w.astype(np.float32), base + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def learn(df: DataFrame, ratings: DataFrame, n_grades: int, f: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal | None:
    """Fit on about ``f.rows`` rated documents, drawn by a hash of their ids; None if fewer than two grades occur.

    Ids must be integers. Ratings with a null id or grade, or a grade outside 0 .. n_grades - 1, are left out.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, n_grades - 1)).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    total = rated.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(f.seed)), F.lit(1_000_000)) / 1_000_000
    sample = rated.where(draw < min(1.0, f.rows / total)).groupBy("id").agg(F.min("grade").alias("grade"))
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(sample), "id").select("id", "grade", "text")  # the sample is bounded by f.rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(f.bits)
        for batch in batches:
            found = [make.of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["id", "grade", "features"])

    kept = joined.mapInArrow(tidy(features), "id long, grade int, features array<int>").where("size(features) > 0").toArrow()
    sizes = pc.list_value_length(kept["features"]).to_numpy()
    order = np.lexsort((sizes, kept["grade"].to_numpy(), kept["id"].to_numpy()))
    kept, sizes = kept.take(order), sizes[order]
    grades = kept["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return None
    index = kept["features"].combine_chunks().flatten().to_numpy()
    del kept
    return fit_ordinal(index, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), grades, n_grades, f)


def score(df: DataFrame, model: Ordinal | None, wanted: int, f: Fit = Fit(), least_tail: float = 0.65, text_col: str = "text") -> DataFrame:
    """``df`` with expected_grade, tail_probability (of grade ``wanted`` or more) and kept appended.

    A null text, or one without words, has grade 0, probability 0 and is not kept. Without a model the
    other texts have null grades and are kept. Columns of the three names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("expected_grade", "tail_probability", "kept")]
    at = names.index(text_col)
    source = df.select(*map(column, names)).toDF(*(f"c{i}" for i in range(len(names))))  # names of the columns cannot clash
    schema = source.select("*").schema.add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Features(f.bits), sent.value
        for batch in batches:
            found = [make.of(t.as_py() or "") for t in batch.column(at)]
            some = np.array([len(x) > 0 for x in found], bool)
            if model:
                c = model.at_most(np.array([model.weights[x].sum(dtype=np.float64) for x in found]).reshape(-1))
                expected = np.where(some, (1 - c).sum(1), 0.0)
                tail = np.where(some, 1 - c[:, wanted - 1], 0.0)
                kept = some & (tail >= least_tail)
                columns = [pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept, pa.bool_())]
            else:
                empty = [None if x else 0.0 for x in some.tolist()]
                columns = [pa.array(empty, pa.float64()), pa.array(empty, pa.float64()), pa.array(some, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "expected_grade", "tail_probability", "kept"])

    return source.mapInArrow(tidy(rate), schema).toDF(*names, "expected_grade", "tail_probability", "kept")


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings 0 to 2: how many of two demands a document meets, being of quality and not being toxic. A null label counts as met."""
    met = F.coalesce(F.col("quality"), F.lit(1)).cast("boolean").cast("int") + 1 - F.coalesce(F.col("toxic"), F.lit(0)).cast("boolean").cast("int")
    return labels.select("doc_id", met.alias("grade"))
