"""The training-data pipeline: quality, line dedup, near duplicates, decontamination, packing.

``run`` applies STAGES to ``documents``; each stage's result is written as Parquet in
the shared folder and read back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import quality
from sievework.llm.common import column, drop, keyed, named, stored, table, without
from sievework.llm.decontaminate import decontaminate
from sievework.llm.jaccard import jaccard_components
from sievework.llm.lines import line_dedup
from sievework.llm.packing import Limits, pack_examples
from sievework.llm.queries import tokenizer_path


def row_key() -> Column:
    """Rows are told apart by id and text, since ids may be null or shared; rows equal in both are copies of one document."""
    return F.xxhash64("doc_id", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the classifier's bound stay.

    Null texts and those without words go. Each row is judged by its own text, so rows with null or shared ids,
    and repeated rows, are treated alike; the classifier learns only from ids that ``labels`` has. Without usable labels
    every text with a word stays. Columns pass unchanged; an empty table gives no rows.
    """
    ratings = quality.grades_of_labels(table(spark, sf_dir, "labels"))
    model = quality.learn(docs, ratings, n_grades=3)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = quality.score(plain, model, wanted=2, text_col=f"c{docs.columns.index('text')}").where("kept")
    return named(kept, docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing but white space is left.

    So null, empty and blank texts go. Of two documents the one with the larger id loses a run, a null id being the
    largest; rows that share an id are at one place, so none of them loses what both have at the same lines.
    ``n_chars`` is counted anew; other columns pass unchanged. An empty table gives no rows.
    """
    left = line_dedup(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else column(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: the smallest id's, a null id being the largest.

    Rows of one id are documents of their own; among those of the smallest id a hash of the text decides, and
    of rows equal in id and text one stays, whatever their other columns hold. Texts without words
    (null, empty, blank) link with nothing and stay, repeats included. Columns pass unchanged; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", row_key().alias("key"))
    found = jaccard_components(rows, id_col="key").where("n_shingles > 0")
    each = rows.groupBy("key").agg(F.first("doc_id").alias("id"), F.count("*").alias("rows"))
    groups = stored(found.select("key", "component_id").distinct().join(each, "key"), "groups")
    place = F.struct(F.col("id").isNull(), "id", "key")
    best = groups.groupBy("component_id").agg(F.min(place).alias("best"))
    later = groups.join(best, "component_id").where(place > F.col("best")).select("key")
    repeated = groups.where("rows > 1").select("key")
    left = without(docs, row_key(), stored(later.union(repeated).distinct(), "later"))
    kept = stored(repeated.join(later, "key", "left_anti"), "repeated")
    ones = named(keyed(docs, row_key()).join(kept, "key").dropDuplicates(["key"]), docs.columns)
    drop(groups)
    return left.unionByName(ones)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Each row is judged by its own text, whatever its id, so rows with null or shared ids and repeated rows are
    treated alike. Null and empty texts hold nothing and stay. Columns pass unchanged; an empty table gives no rows, and
    without benchmark items all rows stay.
    """
    found = decontaminate(docs.select(row_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return without(docs, row_key(), stored(found.where("contaminated").select("key").distinct(), "contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 4096 tokens.

    A null text counts as empty, so each row gives at least one piece, its end token; rows with null or shared ids and
    repeated rows are packed each on its own. An empty table gives no rows.
    """
    return pack_examples(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, limits=Limits(4096, 64, 4096))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier's weights cannot be learned in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if last:
            drop(last)
        last = docs
    return docs
