"""Operator 11: phrases mined by vertical positional inverted lists.

Texts are laid out in blocks: one sequence of word positions with gaps between pieces; words of two languages
are two words. A phrase's list holds the positions at which it starts. Lists of frequent phrases are
extended by a merge join with the postings of the word that follows; the length of a list is the exact frequency.

1. One pass over the texts makes the blocks: the words of a block, and a code for each position.
2. Words are counted over all blocks, dealt by word; the frequent ones get an id, which goes back to the blocks that hold them.
3. For each further length, every block extends its lists and sends the lengths, dealt by phrase; those that
   are frequent in all get an id, which goes back likewise. A phrase is extended only where the phrase without its first word
   is frequent too.

So what crosses a shuffle is one number a block for each phrase that could be frequent, never an occurrence. It crosses in
packed rows of bounded size: Spark never holds an array of a whole block, and a task holds one block or one bucket.
Scores and the phrases that longer ones cover are joins of the frequent phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blobs import records, slices, squeezed_records, starts, unsqueezed_records
from .common import buckets as bucket_count
from .common import column, drop, partitions, stored, tidy

#: Ends of pieces become a full stop; nothing else in a word can be one.
_FOLD = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 20
#: Positions and words in a row of a block.
_ROW, _WORDS = 1 << 16, 1 << 17


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Texts of one language: a code for each position, -1 between pieces."""

    def __init__(self) -> None:
        self.codes = _Codes({b".": 0})
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, text: str) -> None:
        data = text.encode().translate(_FOLD)
        at = 0
        while at < len(data):  # long texts are cut where words end, and go on in the same block
            end = at + _CHUNK
            if end < len(data):
                end = max(data.rfind(b" ", at, end), data.rfind(b".", at, end)) + 1 or min((x for x in (data.find(b" ", end), data.find(b".", end)) if x >= 0), default=len(data))
            words = data[at:end].replace(b".", b" . ").split(b" ")
            self.parts.append(np.fromiter(map(self.codes.__getitem__, filter(None, words)), np.int32))
            at = end
        self.parts.append(np.zeros(1, np.int32))
        self.bytes += len(data) + 32

    def arrays(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Codes by position, the words by code, and how often each occurs; common words have low codes."""
        at = np.concatenate(self.parts) - 1
        n = np.bincount(at[at >= 0], minlength=len(self.codes) - 1)
        order = np.argsort(-n, kind="stable")
        code = np.empty(len(order) + 1, np.int32)
        code[order], code[-1] = np.arange(len(order)), -1
        words = [w for w in self.codes if w != b"."]
        return code[at], [words[i] for i in order], n[order]


_BLOCKS = "block long, level int, part int, data binary, words binary, lang string, n long"
_BLOCK_ROWS = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("words", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])


def _rows(schema: pa.Schema, length: int, **columns: Iterable) -> pa.RecordBatch:
    """Rows with these columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)


def _parts_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (an array that is no slice) begin and end in their joined bytes, and these."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1)
    return ends, np.frombuffer(data, np.uint8, ends[-1])


def _unpacked_words(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """How many words each value has, their codes, how often each occurs, and the words."""
    sizes, (local, n, lengths), text = unsqueezed_records(values, "<i4", "<i8", "<i4")
    ends = np.zeros(len(local) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return sizes, local, n, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(local), [None, pa.py_buffer(ends), pa.py_buffer(text)])


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its codes (level 0; 0 between pieces), its words with their language, and how many words each language has."""
    first, made = TaskContext.get().partitionId() << 32, 0
    open_: dict[str, Block] = defaultdict(Block)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made
        block, made = first + made, made + 1
        at, words, n, totals = [], [], [], {}
        for lang in list(open_):
            codes, own, counts = open_.pop(lang).arrays()
            codes[codes >= 0] += len(words) + 1
            at.append(np.maximum(codes, 0))
            end = b" " + lang.encode()  # a word has no space
            words += [w + end for w in own]
            n.append(counts)
            totals[lang] = int(counts.sum())
        if not words:
            return
        at, n = np.concatenate(at), np.concatenate(n)
        yield _rows(_BLOCK_ROWS, len(totals), lang=list(totals), n=list(totals.values()))
        for part, k in enumerate(range(0, len(at), _ROW)):
            yield _rows(_BLOCK_ROWS, 1, block=[block], level=[0], part=[part], data=[squeezed_records(records(at[k : k + _ROW]))])
        for k in range(0, len(words), _WORDS):
            ends, text = _parts_of(pa.array(words[k : k + _WORDS], pa.binary()))
            local = np.arange(k, k + len(ends) - 1, dtype=np.int32)
            yield _rows(_BLOCK_ROWS, 1, block=[block], words=[squeezed_records(records(local, n[local], np.diff(ends)), text)])

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            size += len(text.as_buffer()) + 32
            open_[lang].add(text.as_py())
            if size >= block_bytes:
                yield from flush()
                size = 0
    yield from flush()


_DEALT = "bucket int, block long, data binary"
_DEALT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def _dealt_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Words of blocks, dealt by word."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            _, local, n, words = _unpacked_words([data.as_py()])
            bucket = np.fromiter(map(crc32, words.to_pylist()), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            ends, text = _parts_of(words.take(pa.array(order)).cast(pa.binary()))
            rows = records(local[order], n[order], np.diff(ends))
            found = [(k, squeezed_records(rows[s], text[ends[s.start] : ends[s.stop]])) for k, s in slices(bucket[order])]
            yield _rows(_DEALT_ROWS, len(found), bucket=[k for k, _ in found], block=[block] * len(found), data=[x for _, x in found])


_FREQUENT = "block long, level int, part int, data binary, lang string, phrase string, id long, a long, b long, f long"
_FREQUENT_ROWS = pa.schema([*list(_BLOCK_ROWS)[:4], ("lang", pa.string()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("id", "a", "b", "f"))])


def _backs(level: int, bucket: int, blocks: list[int], whose: np.ndarray, local: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """One row a block: which of its codes are frequent, and their ids."""
    order = np.argsort(whose, kind="stable")
    rows = records(local[order], ids[order])
    found = [(blocks[k], squeezed_records(rows[s])) for k, s in slices(whose[order])]
    return _rows(_FREQUENT_ROWS, len(found), block=[k for k, _ in found], level=[level] * len(found), part=[bucket] * len(found), data=[x for _, x in found])


def _of_bucket(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[int], list[bytes]]:
    """The bucket, and the block and the value of each of its rows."""
    bucket, blocks, values = 0, [], []
    for batch in batches:
        bucket = batch.column(0)[0].as_py() if batch.num_rows else bucket
        blocks += batch.column(1).to_pylist()
        values += batch.column(2).to_pylist()
    return bucket, blocks, values


def _frequent_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of one bucket: rows without a block are the frequent words, one row a block says which these are in it."""
    bucket, blocks, values = _of_bucket(batches)
    if not blocks:
        return
    sizes, local, n, words = _unpacked_words(values)
    values.clear()
    whose = np.repeat(np.arange(len(blocks), dtype=np.int32), sizes)
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy()
    f = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(f, word, n)
    keep = f >= least
    name = np.cumsum(keep) - 1 + (bucket << 32)
    both = [x.split(b" ", 1) for x in coded.dictionary.filter(pa.array(keep)).to_pylist()]
    yield _rows(_FREQUENT_ROWS, len(both), lang=[x[1].decode() for x in both], phrase=[x[0].decode() for x in both], id=name[keep], f=f[keep])
    member = keep[word]
    yield _backs(1, bucket, blocks, whose[member], local[member], name[word[member]])


def extended(at: np.ndarray, codes: np.ndarray, posted: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of the list of phrases of ``length`` words (``at``, ``codes``) with the postings of words (``posted``, ``words``).

    (positions, phrase codes, codes of the next word) where a frequent phrase starts at the next position too.
    """
    goes_on = np.flatnonzero(at[1:] == at[:-1] + 1)
    at, codes = at[goes_on], codes[goes_on]
    place = np.searchsorted(posted, at + length)
    return at, codes, words[place]  # the next phrase ends with that word, so it is posted


def _in_order(local: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is frequent in a block comes from many buckets in any order; codes must be the same each time."""
    order = np.argsort(local)
    return local[order], ids[order]


def _lists(at: np.ndarray, frequent: dict[int, tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, ...]:
    """Of one block, the phrases of ``length`` words that could be frequent: ids of phrase and word, how often, in order of both codes."""
    ids = {}
    local, ids[1] = frequent[1]
    code = np.full(int(at.max(initial=-1)) + 2, -1, np.int64)
    code[local] = np.arange(len(local))
    word = code[at]  # entry -1 is never frequent
    posted = np.flatnonzero(word >= 0)
    words = word[posted]
    del word
    places, codes = posted, words
    for size in range(1, length):
        places, codes, after = extended(places, codes, posted, words, size)
        codes = codes * (len(local) + 1) + after
        del after
        if size + 1 < length:
            key, codes = np.unique(codes, return_inverse=True)
            known, ids[size + 1] = frequent.get(size + 1, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            named = np.full(len(key) + 1, -1, np.int64)
            named[known] = np.arange(len(known))
            codes = named[codes]
            stay = codes >= 0
            places, codes = places[stay], codes[stay]
    del places
    codes.sort()
    first = np.flatnonzero(starts(codes))
    n = np.diff(np.append(first, len(codes)))
    before, after = np.divmod(codes[first], len(local) + 1)
    return ids[length - 1][before], ids[1][after], n


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _counts(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block come together: its codes (level 0), then what is frequent in it."""

    def flush(block: int, levels: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if 0 not in levels or length - 1 not in levels:
            return
        at = unsqueezed_records(levels.pop(0), "<i4")[1][0] - 1
        a, b, n = _lists(at, {level: _in_order(*unsqueezed_records(levels.pop(level), "<i4", "<i8")[1]) for level in list(levels)}, length)
        del at
        bucket = (_mixed(a, b) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = records(order.astype(np.int32), a[order], b[order], n[order])
        found = [(k, squeezed_records(rows[s])) for k, s in slices(bucket[order])]
        yield _rows(_DEALT_ROWS, len(found), bucket=[k for k, _ in found], block=[block] * len(found), data=[x for _, x in found])

    now, levels = None, defaultdict(list)
    for batch in batches:
        for block, level, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if block != now:
                yield from flush(now, levels)
                now, levels = block, defaultdict(list)
            levels[level].append(data.as_py())
    yield from flush(now, levels)


def _frequent(batches: Iterator[pa.RecordBatch], least: int, length: int) -> Iterator[pa.RecordBatch]:
    """Sums of one bucket: rows without a block are the frequent phrases, one row a block says which these are in it."""
    bucket, blocks, values = _of_bucket(batches)
    if not blocks:
        return
    sizes, (local, a, b, n), _ = unsqueezed_records(values, "<i4", "<i8", "<i8", "<i8")
    values.clear()
    whose = np.repeat(np.arange(len(blocks), dtype=np.int32), sizes)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(starts(a, b))
    f = np.add.reduceat(n[order], new)
    del n
    keep = f >= least
    name = np.cumsum(keep) - 1 + (bucket << 32)
    yield _rows(_FREQUENT_ROWS, int(keep.sum()), id=name[keep], a=a[new[keep]], b=b[new[keep]], f=f[keep])
    del a, b
    size = np.diff(np.append(new, len(order)))
    order, ids = order[np.repeat(keep, size)], np.repeat(name[keep], size[keep])
    yield _backs(length, bucket, blocks, whose[order], local[order], ids)


def frequent_phrases(df: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to ``longest`` words that occur ``least`` times or more, and (lang, n) of all words.

    Both are stored tables. Phrases are joined by single spaces.
    """
    if longest < 1:
        raise ValueError("phrases have a word at least")
    buckets = bucket_count(df.select(column(text_col).alias("text")))
    texts = df.select(F.coalesce(column(lang_col), F.lit("und")).alias("lang"), column(text_col).alias("text")).where("text <> ''")
    blocks = stored(texts.mapInArrow(tidy(lambda b: _blocks(b, block_bytes)), _BLOCKS), "blocks", rows_per_file=256)
    totals = stored(blocks.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = blocks.where("words is not null").select("block", "words").mapInArrow(tidy(lambda b: _dealt_words(b, buckets)), _DEALT)
    found = stored(words.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(lambda b: _frequent_words(b, least)), _FREQUENT), "frequent-words")
    levels, done = [stored(found.where("block is null").select("lang", "phrase", F.lit(1).alias("size"), "f", "id"), "words")], [found]
    of_blocks = lambda rows: rows.where("data is not null").select("block", "level", "part", "data")
    backs = of_blocks(found)
    for size in range(2, longest + 1):
        placed = of_blocks(blocks).unionByName(backs).repartition(buckets, "block").sortWithinPartitions("block", "level", "part").select("block", "level", "data")
        counts = placed.mapInArrow(tidy(lambda b, size=size: _counts(b, size, buckets)), _DEALT)
        found = stored(counts.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(lambda b, size=size: _frequent(b, least, size)), _FREQUENT), f"phrases-{size}")
        rows = found.where("block is null").select("id", "a", "b", "f")
        before = levels[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"))
        last = levels[0].select(F.col("id").alias("b"), F.col("phrase").alias("last"))
        named = rows.join(before, "a").join(last, "b").select("lang", F.concat_ws(" ", "head", "last").alias("phrase"), F.lit(size).alias("size"), "f", "id")
        levels.append(stored(named, f"named-{size}"))
        backs = backs.unionByName(of_blocks(found))
        done.append(found)
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    phrases = stored(phrases.drop("id"), "phrases")
    drop(blocks, *levels, *done)
    return phrases, totals


def _first_rows(scored: DataFrame, most: int, order: list) -> DataFrame:
    """``scored`` with the ``rank`` of the first ``most`` rows of each language; a large language is ranked in parts first."""
    parts = 1 << (8 if partitions(scored.sparkSession) > 8 else 4)
    while parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("rank")
        parts //= 16
    whole = Window.partitionBy("lang").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= most)


def ranked_phrases(phrases: DataFrame, totals: DataFrame, most: int = 2000, cover_percent: int = 80) -> DataFrame:
    """What ``collocations`` returns, from the tables of ``frequent_phrases``."""
    words = F.split("phrase", " ")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    cut = candidates.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * exact("a"), exact("l") + exact("r"))
    scored = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    held = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))).alias("phrase"))
    covered = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    percent = lambda n, c: F.lit(n).cast("decimal(9,0)") * exact(c)
    left = scored.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (percent(100, "longer") < percent(cover_percent, "a")))
    ranked = _first_rows(left, most, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, cover_percent: int = 80, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> DataFrame:
    """The first ``most`` phrases of each language by cohesion: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that occurs ``least`` times (a) or more is scored by 2000000 * a / (l + r), floored, where
    l and r count its two parts at the cut that gives the least score, the earliest of equals. It is left out if a longer phrase that
    holds it occurs in ``cover_percent`` of 100 of its places or more. n counts all words of the language. Ties go by a, largest first, then by the phrase's bytes.

    Words are compared as they are but for A-Z. Null and empty texts have no words; a null language is ``und``. Repeated rows count each. Other columns
    are ignored; an empty table gives no rows.
    """
    return ranked_phrases(*frequent_phrases(df, longest, least, text_col, lang_col, block_bytes), most, cover_percent)
