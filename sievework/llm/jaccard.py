"""Operator 9: exact Jaccard self-join on word shingles by universe partition.

Two sets with a Jaccard similarity of 0.8 or more differ in a bounded number ``k`` of
elements (a quarter of the smaller set). Per band of sizes the universe of hashes is cut
into ``m`` segments; a set's part in a segment has a signature. Unequal signatures need
a differing element each, so a set with more than ``k`` filled segments shares a filled
one with each of its partners. ``m`` is chosen by cost: more signatures against more
sets that fill too few segments. Those sets also emit one-deletion neighbourhoods
(segments of two or more elements then miss only with two differences), and if that
is still too little, every single element.

Sets that share a signature form a group. First each group's sets are compared with
its smallest id only, which joins nearly all of them into components. A group whose
sets lie in one component is settled. A set with more than ``k`` settled segments has met
all partners. Only sets with fewer go on: they are compared with the hubs of their unsettled groups,
which joins more of them, and described by what sets them apart from these: linked sets differ from
a common hub in much the same elements, so a prefix of the rarest of these finds every pair that is left.
Equal sets, and equal signatures, are merged within a task's block of documents first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blobs import BLOB_SCHEMA, from_planes, pack, planes, rows_of_blobs, slices, squeezed, starts, unpack, unsqueezed
from .common import buckets as bucket_count
from .common import drop, free_worker, marked, stored, tidy
from .components import connected_components

SHINGLE = 5
#: Kinds of rows: candidate pair, member of a group, equal pair, document.
PAIR, MEMBER, EQUAL, DOCUMENT = 1, 2, 3, 4


def shingles(text: str | None) -> list[bytes]:
    """Word shingles of a text, repeats included; a text of fewer words is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    if len(words) <= SHINGLE:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(begins[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())]


class WordHashes(dict):
    """Hashes of words, kept for one block of documents and the batch that it ends in."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def word_hashes(texts: pa.Array, known: WordHashes) -> list[np.ndarray]:
    """Hashes of the words of each text; each distinct word of the batch is looked up once."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    places = cut.values.dictionary_encode()
    words = places.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    at = places.indices.to_numpy()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))[at]
    word = np.fromiter(map(len, words), np.int64, len(words))[at] > 0  # white space at either end leaves an empty one
    ends = np.concatenate([[0], np.cumsum(word)])[cut.offsets.to_numpy()]
    return np.split(hashes[word], ends[1:-1]) if len(texts) else []


def hashed_set(w: np.ndarray) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles, mixed from those of its words."""
    n = len(w) - SHINGLE + 1
    if n <= 1:
        return _mix((w * _FACTORS[: len(w)]).sum(keepdims=True)) if len(w) else w
    return np.unique(_mix(sum(w[i : i + n] * f for i, f in enumerate(_FACTORS))))


@lru_cache(maxsize=None)
def band(size: int) -> tuple[int, int, int]:
    """(number, lowest, highest size) of the band that ``size`` is in."""
    number, lo, hi = 0, 1, 3
    while size > hi:
        number, lo = number + 1, hi + 1
        hi = max(lo + 3, lo * 3 // 2)
    return number, lo, hi


def most_apart(sizes: np.ndarray, hi: int) -> np.ndarray:
    """How far sets of ``sizes`` can be from a partner when the smaller of both has at most ``hi`` elements."""
    return np.where(sizes <= hi, sizes // 4, (sizes + hi) // 9)


@lru_cache(maxsize=None)
def segments(lo: int, hi: int) -> int:
    """The number of segments with the least expected cost for sets of ``lo`` to ``hi`` elements.

    Cost: one signature a filled segment, and, with the chance that the elements a set
    has for itself fill too few segments, the signatures of its deletion neighbourhoods.
    A quarter of a set, or 75 elements (but seven tenths of it at most), may lie in a passage that
    very many sets share and so in groups that are not settled.
    """
    if hi < 4:
        return 1

    def short(m: int, n: int) -> float:
        e = max(1, 3 * n // 10, min(3 * n // 4, n - 75))
        empty, pair = (1 - 1 / m) ** e, (1 - 2 / m) ** e if m > 1 else 0.0
        spread = math.sqrt(max(1e-9, m * empty + m * (m - 1) * pair - (m * empty) ** 2))
        return 0.5 * math.erfc((m * (1 - empty) - n // 4 - 0.5) / spread / math.sqrt(2))

    def cost(m: int) -> float:
        return m * (1 - (1 - 1 / m) ** lo) + 20 * lo * max(short(m, lo), short(m, hi))

    return min(range(hi // 4 + 1, 8 * lo + hi // 4 + 2, max(1, lo // 200)), key=cost)


def _mix(h: np.ndarray) -> np.ndarray:
    """Scrambled hashes, whose sums stand for sets."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _salted(sums: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return _mix(sums + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signatures(doc: np.ndarray, h: np.ndarray, all_sizes: np.ndarray, lo: int, hi: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, slack) under one band for sets given as sorted hashes per document.

    slack: how many of a set's groups may stay unsettled before it may miss a partner;
    -1 marks the signatures of sets that fill too few segments (any unsettled group counts).
    """
    k, m = most_apart(all_sizes, hi), segments(lo, hi)
    segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(starts(doc, segment))
    mixed = _mix(h)
    sums = np.add.reduceat(mixed, first)
    sizes = np.diff(np.append(first, len(h)))
    docs, where = doc[first], segment[first]
    filled = np.bincount(docs, minlength=len(all_sizes))
    tag = where * np.uint64(4) + np.uint64(number << 40)
    slack = (filled - (k + 1))[docs]
    out = [(docs, _salted(sums, tag), np.maximum(slack, -1))]
    short = filled < k + 1
    if short[docs].any():
        reach = np.bincount(docs, np.minimum(sizes, 2), minlength=len(filled)).astype(np.int64)
        near = short & (reach >= k + 1)
        s = near[docs]
        out.append((docs[s], _salted(sums[s], tag[s] + np.uint64(1)), np.full(s.sum(), -1)))
        group = np.repeat(np.arange(len(first)), sizes)
        e = near[doc] & (sizes[group] > 1)
        out.append((doc[e], _salted(sums[group[e]] - mixed[e], tag[group[e]] + np.uint64(1)), np.full(e.sum(), -1)))
        e = (short & ~near)[doc]
        out.append((doc[e], _salted(mixed[e], np.uint64((number << 40) + 2)), np.full(e.sum(), -1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bands_of(sizes: np.ndarray) -> dict[tuple[int, int, int], np.ndarray]:
    """Per band, the documents that take part in it: as smaller or as larger set of a pair."""
    out: dict[tuple[int, int, int], list[int]] = {}
    for i, n in enumerate(sizes.tolist()):
        b = band(-(-4 * n // 5))
        out.setdefault(b, []).append(i)
        while b[2] < n:
            b = band(b[2] + 1)
            out.setdefault(b, []).append(i)
    return {b: np.array(x) for b, x in out.items()}


def _apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(n, m) < 4 * np.maximum(n, m)


def _groups(sig: np.ndarray, ids: np.ndarray, sizes: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by signature and id; group number; the first of the group; whether the group has two ids."""
    order = np.argsort(sig)
    new = starts(sig[order])
    shared = np.flatnonzero(~new | ~np.append(new[1:], True))  # the others stand alone, in whatever order their ids are
    part = np.sort(order[shared])
    order[shared] = part[np.lexsort((ids[part], sig[part]))]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    many = (np.bincount(group, ids[order] != ids[order][first]) > 0)[group]
    return order, group, first, many


def _pairs(order: np.ndarray, first: np.ndarray, many: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each group's smallest id with the others: how many groups, and how much slack (16 bits each), they have.

    Pairs whose sizes are too far apart to be linked have no groups.
    """
    a, b = order[first[many]], order[many]
    use = ids[a] != ids[b]
    a, b = a[use], b[use]
    slack = np.clip(np.maximum(tag[a], tag[b]) >> 6, 0, 0xFFFF)
    alike = ~_apart(sizes[a], sizes[b])
    o = np.lexsort((slack, ids[b], ids[a]))
    a, b, slack, alike = ids[a][o], ids[b][o], slack[o], alike[o].astype(np.int64)
    new = np.flatnonzero(starts(a, b)) if len(a) else np.zeros(0, np.int64)
    count = np.add.reduceat(alike, new) if len(a) else alike
    return a[new], b[new], np.minimum(count, 0xFFFF) << 16 | slack[new]


def _even(kind: int, spread: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows that a later step passes on, dealt evenly."""
    bucket = spread % buckets
    order = np.argsort(bucket, kind="stable")
    return [(b, kind, pack(*(planes(c[order][s]) for c in columns))) for b, s in slices(bucket[order])]


def _signature_rows(batches: Iterator[pa.RecordBatch], buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    def flush(ids: list[int | None], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        known = np.array([i is not None for i in ids])
        id_ = np.array([i or 0 for i in ids], np.int64)
        turn = np.arange(len(ids))
        rows = _even(DOCUMENT, turn, buckets, id_, sizes, known.astype(np.int64))
        use = known & (sizes > 0)
        where = turn[use]
        if not len(where):
            return rows_of_blobs(rows)
        sets = [sets[i] for i in where]
        id_, sizes = id_[where], sizes[where]
        doc, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        whole = np.add.reduceat(_mix(h), begin), np.add.reduceat(_mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
        order = np.lexsort((id_, whole[1], whole[0], sizes))
        new = starts(sizes[order], whole[0][order], whole[1][order])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        equal = id_[first] != id_[order]
        rows += _even(EQUAL, np.arange(equal.sum()), buckets, id_[first][equal], id_[order][equal], np.zeros(equal.sum(), np.int64))
        stay = np.zeros(len(sets), bool)
        stay[order[new]] = True
        found = []
        for (number, lo, hi), members in _bands_of(sizes).items():
            members = members[stay[members]]
            if len(members):
                at = np.zeros(len(sets), bool)
                at[members] = True
                pick = at[doc]
                d, s, slack = signatures(doc[pick], h[pick], sizes, lo, hi, number)
                found.append((d, s, slack * 64 + min(number, 63)))
        d, sig, tag = (np.concatenate(x) for x in zip(*found))
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        sig = bucket << 32 | (sig >> np.uint64(32)).astype(np.int64)  # enough within a bucket, whose size is bounded
        order, group, head, many = _groups(sig, id_[d], sizes[d], tag)
        pairs = _pairs(order, head, many, id_[d], sizes[d], tag)
        rows += _even(PAIR, np.arange(len(pairs[0])), buckets, *pairs)
        m = order[many]
        rows += _even(MEMBER, np.arange(len(m)), buckets, sig[m], id_[d[m]], tag[m].astype(np.int64), id_[d[order[head[many]]]])
        one = order[np.unique(head)]
        d, sig, tag, bucket = d[one], sig[one], tag[one], bucket[one]
        entry = (d << 32) + (tag + 128)
        order = np.lexsort((entry, bucket))
        sig, entry, bucket = sig[order].astype(np.uint32), entry[order], bucket[order]
        new = np.flatnonzero(starts(bucket, entry))
        of, times, tag = entry[new] >> 32, np.diff(np.append(new, len(entry))), (entry[new] & 0xFFFFFFFF).astype(np.uint32)
        for b, s in slices(bucket[new]):  # a document's id, size and tag, which stand in each bucket anew, are most of what is shuffled
            at = slice(new[s.start], new[s.stop] if s.stop < len(new) else len(sig))
            columns = (np.diff(id_[of[s]], prepend=0), sizes[of[s]].astype(np.int32), tag[s], times[s].astype(np.int32))
            rows.append((b, 0, pack(*map(squeezed, columns), sig[at], np.array([len(of[s])]))))
        return rows_of_blobs(rows)

    free_worker()
    ids: list[int | None] = []
    sets: list[np.ndarray] = []
    known, size = WordHashes(), 0
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        for id_, words, length in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1), known), sizes):
            ids.append(id_)
            sets.append(hashed_set(words))
            size += length
            if size >= block_bytes or len(ids) >= 20_000:
                yield flush(ids, sets)
                ids, sets, known, size = [], [], WordHashes(), 0
    if ids:
        yield flush(ids, sets)


_ROWS = "kind int, a long, b long, tag long, head long"


def _row_batches(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = (*columns, np.zeros(len(columns[0]), np.int64))[:4]
    for i in range(0, len(columns[0]), 100_000):
        part = [np.ascontiguousarray(x[i : i + 100_000]).astype(np.int64) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *map(pa.array, part)], names=["kind", "a", "b", "tag", "head"])


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one bucket (its number of records is bounded by how many buckets there are) and rows on their way."""
    parts = []
    for batch in batches:
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = data.as_py()
            if kind:
                yield from _row_batches(kind, *(from_planes(x, "<i8") for x in unpack(data, *["u1"] * (4 if kind == MEMBER else 3))))
            else:
                *columns, sig, length = unpack(data, *["u1"] * 4, "<u4", "<i8")
                ids, sizes, tag, times = (unsqueezed(c, kind, int(length[0])) for c, kind in zip(columns, ("<i8", "<i4", "<u4", "<i4")))
                each = (np.cumsum(ids), sizes, (tag.astype(np.int64) - 128).astype(np.int32))
                ids, sizes, tag = (np.repeat(x, times) for x in each)
                parts.append((ids, sizes, bucket << 32 | sig.astype(np.int64), tag))
    if parts:
        ids, sizes, sig, tag = (np.concatenate(x) for x in zip(*parts))
        order, _, first, many = _groups(sig, ids, sizes, tag)
        yield from _row_batches(PAIR, *_pairs(order, first, many, ids, sizes, tag.astype(np.int64)))
        m = order[many]
        yield from _row_batches(MEMBER, sig[m], ids[m], tag[m], ids[order[first[many]]])


_COMPARED = "row long, hub long, id long, c long, n int, d int, linked boolean, x array<long>"


def _compare(batches: Iterator[pa.RecordBatch], delta: bool, batch_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Texts in order of hub, a hub's own (their id is null) before those compared with it.

    x: hashes of the shingles in which a text differs from the hub's first text, d: how many; row: a number of its own.
    """
    out: list[tuple[int, int, int, int | None, int, int | None, bool, np.ndarray | None]] = []
    at, last, sets, size, row = None, None, [], 0, TaskContext.get().partitionId() << 40

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 8
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "hub", "id", "c", "n", "d", "linked", "x"])

    for batch in batches:
        for hub, part, id_, c, key, text in zip(*(x.to_pylist() for x in batch.columns[:5]), batch.column(5)):
            if last == (last := (hub, part, id_, key)):
                continue  # a repeated row
            mine = frozenset(shingles(text.as_py()))
            if id_ is None:
                if at != (hub, part):
                    at, sets = (hub, part), []
                sets.append(mine)
                continue
            shared = [(len(mine & s), len(s)) for s in sets]
            linked = any(k and 100 * k >= 80 * (len(mine) + n - k) for k, n in shared)
            x = np.fromiter(map(xxhash.xxh3_64_intdigest, mine ^ sets[0]), np.uint64).view(np.int64) if delta else None
            out.append((row, hub, id_, c, len(mine), len(x) if delta else None, linked, x))
            row += 1
            size += 64 + (x.nbytes if delta else 0)
            if size >= batch_bytes:
                yield rows()
                size = 0
    yield rows()


def _against_hubs(pairs: DataFrame, docs: DataFrame, n: int, delta: bool = False, part_size: int = 256) -> DataFrame:
    """``pairs`` (hub, id, and c, which is passed on) with the texts compared: columns as _COMPARED; one row per text of the id.

    A hub's pairs are dealt in parts of about ``part_size``, and its text goes once to each.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / part_size).alias("parts"))
    c = F.col("c") if "c" in pairs.columns else F.lit(None).cast("long").alias("c")
    dealt = stored(pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", c), "dealt")
    named = dealt.select("id").union(dealt.select("hub")).distinct()
    texts = marked(docs.where("text is not null"), F.col("id"), named).where("__near").select(F.col("id").alias("of"), "text")
    none = F.lit(None).cast("long")
    hubs = dealt.select("hub", "part").distinct().select("hub", "part", none.alias("id"), none.alias("c"), F.col("hub").alias("of"))
    wanted = dealt.select("hub", "part", "id", "c", F.col("id").alias("of")).unionByName(hubs)  # so that texts are shuffled for both at once
    rows = wanted.join(texts, "of").select("hub", "part", "id", "c", F.xxhash64("text").alias("key"), "text")
    placed = rows.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("id"), "key")
    found = stored(placed.mapInArrow(tidy(lambda b: _compare(b, delta)), _COMPARED), "compared")
    drop(dealt)
    return found


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _open_members(members: DataFrame, met: DataFrame, component: DataFrame) -> DataFrame:
    """Members (sig, id, tag) of all groups in several components, and of a few others.

    In such a group some member's component is not that of its head, so their pair is in ``met``. Bitmaps of these pairs, and of the
    groups that they show, drop nearly all other members before a shuffle.
    """
    of = lambda end: component.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    placed = met.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = stored(placed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.xxhash64("a", "b").alias("pair")), "apart")
    seen = stored(marked(members, F.xxhash64("head", "id"), apart).where("__near").select("sig").distinct(), "open-groups")
    found = stored(marked(members, F.col("sig"), seen).where("__near").select("sig", "id", "tag"), "open-members")
    drop(apart, seen)
    return found


def _unsettled(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members of groups in several components, of sets with too few settled groups to have met all partners.

    Columns: sig, id, tag, c (component), weight: how large the set's groups are in all, n: how many
    it has.
    """
    placed = members.repartition("id").distinct().join(component, "id", "left").select("sig", "id", "tag", F.coalesce("component", "id").alias("c"))  # one shuffle for both
    group, mine = Window.partitionBy("sig"), Window.partitionBy("id", "tag")
    open_ = placed.withColumns({"c0": F.min("c").over(group), "c1": F.max("c").over(group), "g": F.count("*").over(group)}).where("c0 <> c1")
    counted = open_.withColumns({"n": F.count("*").over(mine), "weight": F.sum("g").over(mine)}).where(F.col("n") > F.shiftright("tag", 6))
    return stored(counted.select("sig", "id", "tag", "c", "weight", "n"), "unsettled")


def _clusters(left: DataFrame) -> DataFrame:
    """(hub, id, c): each set with the weightiest members of its unsettled groups, and each of those with itself.

    Two linked sets share more unsettled groups than either's slack. A set may leave out hubs that stand for half
    its slack at most, so some group that both share puts both with the same hub.
    """
    hubs = left.groupBy("sig").agg(F.max(F.struct("weight", F.col("id").alias("hub"), F.col("c").alias("of_hub"))).alias("h")).select("sig", "h.hub", "h.of_hub")
    groups = left.join(hubs, "sig").groupBy("id", "tag", "n", "c", "hub").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("id", "tag").orderBy(F.desc("k"), "hub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slack = F.greatest(F.shiftright("tag", 6), F.lit(0))
    near = groups.withColumn("before", before).where(2 * (F.col("n") - F.col("before")) > slack).select("hub", "id", "c")
    return near.union(hubs.select("hub", F.col("hub").alias("id"), F.col("of_hub").alias("c"))).distinct()


def _near_hubs(compared: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (hub, id) that may be linked across components, from how each set differs from a common hub.

    Sets of n and m elements that differ from the hub in x and y elements are linked if these differences
    share at least ((9x - n) + (9y - m)) / 18 elements. Where that is nothing, the set of the
    hub's least 9x - n is linked with both. Otherwise the rarest of x hold a shared element even
    without the last of them, as many as must be shared less one; of two sets the one with the smaller 9x - n
    (low) must share more of its own, so fewer of its elements are looked at. Elements that lie in one
    component only are the rarest of all; they stand first and meet nobody. Elements are shuffled with their row's number
    and component only, hub and element hashed to one number: equal hashes of others could but add pairs that are then compared.
    """
    left = compared.select("row", "hub", "id", "n", "d").join(component, "id", "left")
    placed = stored(left.select("row", "hub", "id", F.coalesce("component", "id").alias("c"), "n", "d", (9 * F.col("d") - F.col("n")).alias("e")), "placed")
    members = placed.select("hub", "id", "c", "e")
    least = members.groupBy("hub").agg(F.min(F.struct("e", "id", "c")).alias("best"))
    apart = members.join(least, "hub").where("c <> best.c")
    sure = apart.where("e + best.e <= 0").select(F.col("best.id").alias("hub"), "id")
    bounds = stored(least.join(apart.groupBy("hub").agg(F.min("e").alias("second")), "hub"), "bounds")  # so that a large hub's sets are split where they meet it
    other = F.when(F.col("c") == F.col("best.c"), F.col("second")).otherwise(F.col("best.e"))
    shared = lambda e: F.greatest(F.lit(1), F.ceil((F.col("e") + e) / 18))
    sized = placed.join(bounds, "hub").withColumn("low", F.col("d") - shared(F.greatest("e", other)) + 1).withColumn("high", F.col("d") - shared(other) + 1)
    sized = stored(sized.where("high > 0").select("row", "id", "c", "n", "d", "e", "low", "high"), "sized")
    near = marked(compared.select("row", "hub", "x"), F.col("row"), sized.select("row")).where("__near").select("row", "hub", "x")
    exploded = near.join(sized.select("row", "c"), "row").select("row", "c", "hub", F.explode("x").alias("h"))
    elements = exploded.select("row", "c", F.xxhash64("hub", "h").alias("h"))
    same = Window.partitionBy("h")
    common = elements.withColumns({"f": F.count("*").over(same), "c0": F.min("c").over(same), "c1": F.max("c").over(same)}).where("c0 <> c1")
    met = common.select("row", "f", "h").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s")).join(sized, "row")
    own = F.col("d") - F.size("s")
    most = F.greatest(F.lit(0), F.least(F.size("s"), F.col("high") - own)).cast("int")
    heads = met.withColumn("own", own).select("id", "c", "n", "d", "e", "low", "own", F.posexplode(F.slice("s", 1, most)).alias("at", "s"))
    heads = stored(heads.select(F.col("s.h").alias("h"), "id", "c", "n", "d", "e", "low", (F.col("own") + F.col("at") + 1).alias("r")), "heads")
    one, two = heads.where("r <= low").alias("i"), heads.alias("j")
    first = F.struct("i.e", "i.id") < F.struct("j.e", "j.id")
    most = F.least("i.r", "j.r") + F.least(F.col("i.d") - F.col("i.r"), F.col("j.d") - F.col("j.r"))
    alike = 5 * F.least("i.n", "j.n") >= 4 * F.greatest("i.n", "j.n")
    pairs = one.join(two, "h").where((F.col("i.c") != F.col("j.c")) & first & alike & (18 * most >= F.col("i.e") + F.col("j.e")))
    found = stored(pairs.select(F.least("i.id", "j.id").alias("hub"), F.greatest("i.id", "j.id").alias("id")).union(sure).distinct(), "pairs")
    drop(heads, bounds, placed, sized)
    return found


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links).

    Documents link when the sets of their five-word shingles (ASCII letters lower-cased) have a
    Jaccard similarity of 0.8 or more. Null and empty texts have no shingles and link with nothing.
    Rows that share an id are one document: links of any of its texts count. A null id links
    with nothing and has a null component. Ids must be integers, or text that casts to them. Other columns are ignored; an empty table
    gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = bucket_count(docs, bucket_bytes=4 << 20)  # a task's arrays are some forty times the bytes of its texts
    dealt = docs.mapInArrow(tidy(lambda b: _signature_rows(b, n, block_bytes)), BLOB_SCHEMA)
    rows = stored(dealt.repartitionById(n, F.col("bucket")).mapInArrow(tidy(_group_rows), _ROWS), "groups")
    kind = lambda k: rows.where(F.col("kind") == k)
    met = stored(kind(PAIR).groupBy("a", "b").agg(F.sum(F.shiftright("tag", 16)).alias("groups"), F.min(F.col("tag").bitwiseAND(0xFFFF)).alias("slack")), "met")
    pairs = met.where("2 * groups > slack").select(F.col("a").alias("hub"), F.col("b").alias("id"))  # the others are left to the later rounds
    links = _against_hubs(pairs, docs, n)
    component = connected_components(_links(links).unionByName(kind(EQUAL).select("a", "b")))
    members = _open_members(kind(MEMBER).select(F.col("a").alias("sig"), F.col("b").alias("id"), "tag", "head"), met, component)
    left = _unsettled(members, component)
    drop(met, members)
    done = [links]

    def joined(found: DataFrame) -> DataFrame:
        both = connected_components(found.unionByName(component.select(F.col("component").alias("a"), F.col("id").alias("b"))))
        drop(component)
        return both

    if not left.isEmpty():
        clusters = stored(_clusters(left), "clusters")
        near = _against_hubs(clusters, docs, n, delta=True)
        component = joined(_links(near))
        last = _near_hubs(near, component)
        links = _against_hubs(last, docs, n)
        component = joined(_links(links))
        done += [clusters, near, last, links]
    all_docs = kind(DOCUMENT).select(F.when(F.col("tag") == 1, F.col("a")).alias("id"), F.col("b").alias("n_shingles"))
    found = stored(all_docs.join(component, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")), "found")
    drop(rows, left, component, *done)
    return found
