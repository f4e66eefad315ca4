"""Operator 13: best-fit packing by a grouping genetic algorithm.

Documents become pieces of at most a sequence's length; full pieces are sequences already. The others are dealt to
districts of bounded size. Each district is packed by a few islands: a population of packings, whose
genes are whole bins. A crossover injects well-filled bins of one parent into the other, removes
the bins that held the same pieces, and puts the displaced pieces back by best fit, longest first. After each round the best
packings of an island migrate to the next one of its district. Bins that are all but full are final; the pieces of all other
bins are dealt anew to fewer districts, until one is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import slices
from .common import column, drop, partitions, stored
from .packing import _by_size, _word_ids


@dataclass(frozen=True)
class Evolution:
    """How long and how widely is searched; none of these leaves a piece out."""

    district: int = 4096
    islands: int = 3
    rounds: int = 2
    population: int = 6
    generations: int = 40
    patience: int = 12
    elites: int = 2
    #: Bins with this many free places or fewer are final.
    spare: int = 4
    #: Pieces are dealt anew only while the rest is at most this share of them.
    progress: float = 0.75


@lru_cache(maxsize=4)
def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n + 1)]


def best_fit(free: list[int], lengths: list[int], capacity: int) -> list[int]:
    """The bin of each piece, put one after the other into the fullest bin that still has room, else into a new one.

    Bins are kept by their free places; a number's bits say which of these occur, so the fullest that fits is its lowest set bit.
    """
    power, stacks, bits, n = _powers(capacity), {}, 0, len(free)
    for b, f in enumerate(free):
        if f:
            stacks.setdefault(f, []).append(b)
    for f in stacks:
        bits |= power[f]
    out = []
    for need in lengths:
        above = bits >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                bits ^= power[room]
                del stacks[room]
        else:
            b, room, n = n, capacity, n + 1
        rest = room - need
        if rest:
            if rest in stacks:
                stacks[rest].append(b)
            else:
                stacks[rest] = [b]
                bits |= power[rest]
        out.append(b)
    return out


class Packings:
    """Packings of one district: arrays that give each piece its bin, bins numbered from 0."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lengths, self.capacity, self.rng = lengths.astype(np.int64), capacity, rng
        self.least = -(-int(self.lengths.sum()) // capacity)

    def fill(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths, minlength=1).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> tuple[int, int]:
        """Fewer bins first; of equally many, those that are filled most unevenly."""
        fill = self.fill(bins)
        return -len(fill), int((fill * fill).sum())

    def ideal(self, bins: np.ndarray) -> bool:
        """Nothing is left to gain: all bins but one are full."""
        fill = self.fill(bins)
        return len(fill) == self.least and int((fill < self.capacity).sum()) <= 1

    def placed(self, bins: np.ndarray, loose: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        """``bins`` with the pieces ``loose`` (their entries do not count) put by best fit, longest first."""
        bins = bins.copy()
        bins[loose] = -1
        used, bins_ = np.unique(bins, return_inverse=True)
        bins = (bins_ - (len(used) > 0 and used[0] == -1)).astype(np.int64)
        fixed = bins >= 0
        fill = np.bincount(bins[fixed], self.lengths[fixed]).astype(np.int64) if fixed.any() else np.zeros(0, np.int64)
        if order is None:
            order = loose[np.argsort(-self.lengths[loose], kind="stable")]
        bins[order] = best_fit((self.capacity - fill).tolist(), self.lengths[order].tolist(), self.capacity)
        return bins

    def first(self, noise: float) -> np.ndarray:
        every = np.arange(len(self.lengths))
        order = np.argsort(-self.lengths * (1 + noise * self.rng.standard_normal(len(every))), kind="stable")
        return self.placed(np.full(len(every), -1), every, order)

    def crossover(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` with some of the best-filled bins of ``b``."""
        fill = self.fill(b)
        good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 4), replace=False)] = True
        given = chosen[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[given]] = True
        child = np.where(given, b + len(hit), a)
        return self.placed(child, np.flatnonzero(hit[a] & ~given))

    def mutated(self, a: np.ndarray) -> np.ndarray:
        """``a`` without its emptiest bins and a few others, whose pieces are put anew."""
        fill = self.fill(a)
        gone = np.zeros(len(fill), bool)
        gone[np.argsort(fill, kind="stable")[: 1 + len(fill) // 50]] = True
        gone[self.rng.integers(0, len(fill), 2 + len(fill) // 50)] = True
        return self.placed(a, np.flatnonzero(gone[a]))

    def evolve(self, known: list[np.ndarray], e: Evolution) -> list[np.ndarray]:
        """The best packings found from ``known`` ones, or from none."""
        population = [(self.fitness(x), x) for x in known]
        while len(population) < max(2, e.population) and not any(self.ideal(x) for _, x in population):
            x = self.first(0.0 if not population else 0.3)
            population.append((self.fitness(x), x))
        population.sort(key=lambda p: p[0], reverse=True)
        still = 0
        for _ in range(e.generations):
            if still >= e.patience or self.ideal(population[0][1]):
                break
            i, j = sorted(self.rng.choice(len(population), 2, replace=False).tolist())
            child = self.crossover(population[i][1], population[j][1])
            if self.rng.random() < 0.5:
                child = self.mutated(child)
            value = self.fitness(child)
            still = 0 if value > population[0][0] else still + 1
            if value > population[-1][0] and all(value != v for v, _ in population):
                population[-1] = value, child
                population.sort(key=lambda p: p[0], reverse=True)
        return [x for _, x in population[: e.elites]]


_ISLANDS = "district long, island int, uids array<long>, lengths array<int>, packings array<array<int>>, bins int, squares long, ideal boolean"


def _evolved(batches: Iterator[pa.RecordBatch], capacity: int, e: Evolution, turn: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in _ISLANDS.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            district, island = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            uids, lengths = (batch.column(c)[i].values for c in (2, 3))
            known = [np.array(x, np.int64) for x in batch.column(4)[i].as_py() or []]
            pack = Packings(lengths.to_numpy(), capacity, np.random.default_rng([district, island, turn]))
            best = pack.evolve(known, e)
            value = pack.fitness(best[0])
            row = [district, island, uids, lengths, best, -value[0], value[1], pack.ideal(best[0])]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)


_PLACED = "uid long, length int, sequence_id long, offset long, spare int"


def _settled(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces in the sequences of a packing; a sequence has the number of its first piece."""
    for batch in batches:
        for uids, lengths, packings in zip(*batch.columns):
            uids, lengths, bins = uids.values.to_numpy(), lengths.values.to_numpy(), np.array(packings[0].as_py(), np.int64)
            order = np.lexsort((uids, bins))
            uids, lengths, bins = uids[order], lengths[order].astype(np.int64), bins[order]
            sequence, offset, spare = np.empty_like(uids), np.empty_like(lengths), np.empty(len(uids), np.int32)
            for _, s in slices(bins):
                end = np.cumsum(lengths[s])
                sequence[s], offset[s], spare[s] = uids[s.start], end - lengths[s], capacity - end[-1]
            columns = (uids, lengths.astype(np.int32), sequence, offset, spare)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["uid", "length", "sequence_id", "offset", "spare"])


def evolved_sequences(pieces: DataFrame, capacity: int, e: Evolution = Evolution()) -> DataFrame:
    """(uid, sequence_id, offset) of ``pieces`` (uid long, distinct; length int, from 1 to ``capacity``): a stored table."""
    spark = pieces.sparkSession
    rest, done, tier = pieces.select("uid", "length"), [], 0
    n = rest.count()
    while n:
        districts = -(-n // e.district)
        dealt = rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(tier)), F.lit(districts)).alias("district")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
        none = F.lit(None).cast("array<array<int>>").alias("packings")
        start = dealt.select("district", F.explode(F.sequence(F.lit(0), F.lit(e.islands - 1))).alias("island"), F.col("x.uid").alias("uids"), F.col("x.length").alias("lengths"), none)
        width = max(partitions(spark), -(-districts * e.islands // 32))
        evolve = lambda rows, turn: stored(rows.repartition(width).mapInArrow(lambda b: _evolved(b, capacity, e, turn), _ISLANDS), "islands")
        turn = tier * e.rounds
        islands = evolve(start, turn)
        for r in range(1, e.rounds):
            open_ = islands.groupBy("district").agg(F.max("ideal").alias("ideal")).where("not ideal").select("district")
            if open_.isEmpty():
                break
            guests = islands.select("district", ((F.col("island") + 1) % e.islands).alias("island"), F.col("packings").alias("guests"))
            meeting = islands.join(open_, "district").join(guests, ["district", "island"])
            moved = evolve(meeting.select("district", "island", "uids", "lengths", F.array_distinct(F.concat("packings", "guests")).alias("packings")), turn + r)
            settled = islands.join(open_, "district", "left_anti")
            islands_before, islands = islands, stored(settled.unionByName(moved), "islands")
            drop(islands_before, moved)
        best = islands.groupBy("district").agg(F.max_by(F.struct("uids", "lengths", "packings"), F.struct(-F.col("bins"), "squares", -F.col("island"))).alias("b"))
        placed = stored(best.select("b.uids", "b.lengths", "b.packings").mapInArrow(lambda b: _settled(b, capacity), _PLACED), "placed")
        drop(islands)
        again = placed.where(F.col("spare") > e.spare).count()
        if districts == 1 or again > e.progress * n:
            again = 0
            done.append((placed, placed))
        else:
            done.append((placed, placed.where(F.col("spare") <= e.spare)))
        rest, n, tier = placed.where(F.col("spare") > e.spare).select("uid", "length"), again, tier + 1
    found = spark.createDataFrame([], "uid long, sequence_id long, offset long")
    for _, final in done:
        found = found.unionByName(final.select("uid", "sequence_id", "offset"))
    found = stored(found, "sequences")
    drop(*(t for t, _ in done))
    return found


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, uid long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, capacity: int, batch_chars: int) -> Iterator[pa.RecordBatch]:
    encoder = _word_ids(tokenizer_path)
    uid = TaskContext.get().partitionId() << 40
    end = np.array([end_id], "<u4").tobytes()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        keys, texts = (c.to_pylist() for c in batch.columns)
        for a, b in _by_size(texts, [""] * len(texts), batch_chars):
            rows = []
            for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                view = memoryview(ids + end)
                for i, start in enumerate(range(0, len(view) // 4, capacity)):
                    part = view[4 * start : 4 * (start + capacity)]
                    rows.append((key, i, start, len(part) // 4, zlib.crc32(part), uid))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])


def pack_evolved(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, evolution: Evolution = Evolution(), id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4 << 20) -> DataFrame:
    """Pack every document into as few sequences of at most ``capacity`` tokens as the search finds; one row per piece.

    Columns: ``id_col``, piece (from 0), start, length, ids_crc32, sequence_id, offset. A document's ids are those of its text, then
    ``end_id``; a null text counts as empty, so each row has a piece. Only longer documents are cut, into full pieces and
    a last one. Rows with null or shared ids and repeated rows are packed each on its own; ids must be integers, or text that casts to
    them. Other columns are ignored; an empty table gives no rows.
    """
    source = df.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    pieces = stored(source.mapInArrow(lambda b: _pieces(b, tokenizer_path, end_id, capacity, batch_chars), _PIECES), "pieces")
    sequences = evolved_sequences(pieces.where(F.col("length") < capacity), capacity, evolution)
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    both = full.unionByName(pieces.where(F.col("length") < capacity).join(sequences, "uid"))
    return both.select(F.col("doc_id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
