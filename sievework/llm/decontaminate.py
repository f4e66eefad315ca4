"""Operator 1: benchmark decontamination by a distributed positional inverted index.

1. Count in the corpus every term of the benchmark.
2. For each window of an item choose its rarest terms; these are indexed: one row per
   term and document with the positions, stored in the shared folder.
3. Subtract a term's place in the item from its positions in the document. Where the
   lists of an item agree on an offset for as many places as a window chose, the item
   may occur there (exact phrases); where they agree within a span, its terms occur
   near each other (proximity).
4. Compare item and document word by word at these offsets.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FOLD, column, drop, marked, stored, tidy


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def phrases(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct word sequences of the items: pid, phrase (words joined by spaces), items (their ids as strings)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [b" ".join(words(t)).decode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.string())], names=["item", "phrase"])

    folded = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null").mapInArrow(fold, "item string, phrase string")
    return folded.where("phrase <> ''").groupBy("phrase").agg(F.collect_set("item").alias("items")).select(F.xxhash64("phrase").alias("pid"), "phrase", "items")


def _blocks(terms: DataFrame, most_bytes: int) -> Iterator[list[bytes]]:
    """The terms in blocks of about ``most_bytes``, each small enough to send to every task."""
    block, size = [], 0
    for (term,) in terms.toLocalIterator():
        block.append(term.encode())
        size += len(block[-1]) + 40
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def term_counts(docs: DataFrame, terms: DataFrame, block_bytes: int) -> DataFrame:
    """How often each of ``terms`` occurs in all texts: term, n (terms that never occur are absent)."""

    def counter(block: list[bytes]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = frozenset(sent.value).__contains__
            total: Counter[bytes] = Counter()
            for batch in batches:
                for text in batch.column(0):
                    total.update(filter(known, words(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        return docs.select("text").mapInArrow(tidy(count), "term string, n long")

    return _union([counter(b) for b in _blocks(terms, block_bytes)] or [terms.select("term", F.lit(0).cast("long").alias("n")).limit(0)]).groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, block_bytes: int) -> DataFrame:
    """The index: term, id, key, positions (ascending), for ``terms`` only."""

    def poster(block: list[bytes]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = frozenset(sent.value)
            out: list[tuple[str, int | None, int, list[int]]] = []

            def rows() -> pa.RecordBatch:
                columns = list(zip(*out)) or [(), (), (), ()]
                out.clear()
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "id", "key", "positions"])

            for batch in batches:
                for id_, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    all_words = words(text.as_py())
                    found: dict[bytes, list[int]] = {}
                    if not wanted.isdisjoint(all_words):
                        for i, w in enumerate(all_words):
                            if w in wanted:
                                found.setdefault(w, []).append(i)
                    out.extend((t.decode(), id_, key, p) for t, p in found.items())
                    if len(out) >= 20_000:
                        yield rows()
            yield rows()

        return docs.select("id", "key", "text").mapInArrow(tidy(post), "term string, id long, key long, positions array<int>")

    return _union([poster(b) for b in _blocks(terms, block_bytes)])


def anchors(items: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """Places to index: pid, q (place in the item), term, need (places that an occurring window agrees on)."""
    places = items.select("pid", F.posexplode(F.split("phrase", " ")).alias("q", "term"), F.size(F.split("phrase", " ")).alias("size"))
    known = places.join(counts, "term", "left").select("pid", "q", "term", "size", F.coalesce("n", F.lit(0)).alias("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - (window - 1)), F.greatest(F.lit(0), F.least(F.col("q"), F.col("size") - window)))
    by_window = Window.partitionBy("pid", "s").orderBy("n", "q")
    ranked = known.withColumn("s", F.explode(starts)).withColumn("rank", F.row_number().over(by_window))
    absent = F.min("n").over(Window.partitionBy("pid", "s")) == 0  # such a window occurs nowhere
    chosen = ranked.withColumn("absent", absent).where(~F.col("absent") & (F.col("rank") <= rarest))
    return chosen.select("pid", "q", "term", F.least(F.col("size"), F.lit(rarest)).alias("need")).distinct()


def offsets(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Offset-adjusted intersection: id, key, pid, delta for documents where enough of an item's places agree."""
    hits = index.join(chosen, "term").select("id", "key", "pid", "need", "q", F.explode("positions").alias("p"))
    agreed = hits.groupBy("id", "key", "pid", "need", (F.col("p") - F.col("q")).alias("delta")).agg(F.count("*").alias("n"))
    return agreed.where("n >= need").select("id", "key", "pid", "delta")


def proximity(index: DataFrame, chosen: DataFrame, span: int) -> DataFrame:
    """Documents with at least ``need`` of an item's indexed places within ``span`` words: id, key, pid, n_places, first, last."""
    hits = index.join(chosen, "term").select("id", "key", "pid", "need", "q", F.explode("positions").alias("p"))
    near = Window.partitionBy("id", "key", "pid").orderBy("p").rangeBetween(0, span - 1)
    seen = hits.select("id", "key", "pid", "need", F.col("p").alias("first"), F.size(F.collect_set("q").over(near)).alias("n_places"), F.max("p").over(near).alias("last"))
    return seen.where("n_places >= need").groupBy("id", "key", "pid").agg(F.max(F.struct("n_places", -F.col("first"), "last")).alias("b")).select("id", "key", "pid", "b.n_places", (-F.col("b.col2")).alias("first"), "b.last")


def proximity_matches(df: DataFrame, benchmark: DataFrame, span: int = 20, window: int = 10, rarest: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """Near matches, one row per document and item: id, item, n_places, first, last (document words).

    An item's indexed places are the ``rarest`` terms of each of its windows that can occur. It is near where ``span`` consecutive words hold
    as many of these places as an exact window needs, in any order and with anything between; the row tells of the stretch that holds most, the
    earliest of equals. Nulls, repeats and ids are as in ``decontaminate``, but rows equal in id and text give one row.
    """
    docs = df.select(column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col)).alias("key"), column(text_col).alias("text")).dropDuplicates(["id", "key"])
    items = stored(phrases(benchmark, item_col, item_text_col), "phrases")
    counts = term_counts(df.select(column(text_col).alias("text")), items.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), block_bytes)
    chosen = stored(anchors(items, counts, window, rarest), "anchors")
    empty = df.sparkSession.createDataFrame([], f"`{id_col}` long, item string, n_places int, first int, last int")
    if chosen.isEmpty():
        return empty
    index = postings(docs, chosen.select("term").distinct(), block_bytes)
    near = proximity(index, chosen, span).join(items, "pid").select(F.col("id").alias(id_col), F.explode("items").alias("item"), F.col("n_places").cast("int").alias("n_places"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    found = stored(near, "near")
    drop(items, chosen)
    return found


def matched(doc: list[bytes], item: list[bytes], delta: int, window: int) -> list[tuple[int, int]]:
    """Ranges of document words that lie in occurrences of the item's windows at this offset."""
    need = min(window, len(item))
    out, run = [], 0
    for q, w in enumerate(item):
        p = q + delta
        run = run + 1 if 0 <= p < len(doc) and doc[p] == w else 0
        if run >= need:
            out.append((p - run + 1, p + 1))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, hits.

    A document word is hit if it lies in an occurrence of a window: ``window`` consecutive
    words of an item, or all words of a shorter one. ``hits`` lists the hit ranges
    (first, end). Null and empty texts have no words; items without words, or with a null id,
    are left out. Rows that share an id and a text give equal rows; a null id is
    a document like others; ids must be integers, or text that casts to them. Without documents there are no rows, without items no hits.
    """
    docs = df.select(column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col)).alias("key"), column(text_col).alias("text"))
    items = stored(phrases(benchmark, item_col, item_text_col), "phrases")
    terms = items.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    counts = stored(term_counts(docs, terms, block_bytes), "terms")
    chosen = stored(anchors(items, counts, window, rarest), "anchors")
    searched = chosen.select("term").distinct()
    empty = df.sparkSession.createDataFrame([], "term string, id long, key long, positions array<int>")
    index = stored(postings(docs, searched, block_bytes), "postings") if not chosen.isEmpty() else empty
    by_item = offsets(index, chosen).groupBy("id", "key", "pid").agg(F.collect_set("delta").alias("deltas"))  # at most as many as the document has words
    found = stored(by_item.join(items, "pid").groupBy("id", "key").agg(F.collect_list(F.struct("phrase", "deltas", "items")).alias("found")), "candidates")
    placed = marked(docs, F.xxhash64("id", "key"), found.select(F.xxhash64("id", "key").alias("k")).distinct())
    d, f = placed.where("__near").alias("d"), found.alias("f")
    candidates = d.join(f, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.key") == F.col("f.key")), "left").select("d.id", "d.text", F.coalesce("f.found", F.array()).alias("found"))
    joined = placed.where("not __near").select("id", "text", F.array().cast(candidates.schema["found"].dataType).alias("found")).unionByName(candidates)
    drop(counts, chosen, items, *([] if index is empty else [index]))
    schema = f"`{id_col}` long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<first:int,end:int>>"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                doc = words(text.as_py())
                ranges: set[tuple[int, int]] = set()
                names: set[str] = set()
                for f in found.as_py():
                    item = f["phrase"].encode().split()
                    at = [x for delta in f["deltas"] for x in matched(doc, item, delta, window)]
                    if at:
                        ranges.update(at)
                        names.update(f["items"])
                merged: list[list[int]] = []
                for a, b in sorted(ranges):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                hit = sum(b - a for a, b in merged)
                digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                out.append((id_, len(doc), hit, len(names), digest, hit > 0, [{"first": a, "end": b} for a, b in merged]))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"])

    return joined.mapInArrow(tidy(verify), schema)
