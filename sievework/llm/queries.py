"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, quality
from .audit import filter_audit
from .collocations import collocations
from .common import table
from .decontaminate import decontaminate
from .genetic import pack_evolved
from .jaccard import jaccard_components
from .language import held_out_languages
from .lines import line_dedup
from .packing import Limits, pack_examples
from .rules import quality_rules
from .substrings import substring_dedup
from .tokens import token_counts
from .urls import Rule, filter_urls, path


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies: in SIEVEWORK_TOKENIZERS, or with its package."""
    if folder := os.environ.get("SIEVEWORK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: The url rules of query op5.
URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_examples(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, limits=Limits(4096, 64, 4096))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=512)


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages show documents; the number in a page's path is the document's id, so the document's labels are the page's outcome."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    shown = F.try_to_number(F.regexp_extract(path(F.col("url")), "^/[^/]*/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    outcomes = pages.select("page_id", shown.alias("doc_id")).join(labels.select("doc_id", bad.cast("int").alias("bad")), "doc_id").select("page_id", "bad")
    return filter_urls(pages, outcomes, URL_RULES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, quality.grades_of_labels(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.score(docs, model, wanted=2).select("doc_id", "expected_grade", "tail_probability", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup(table(spark, sf_dir, "documents"), counts=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_evolved(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_url_reputation": op5_url_reputation,
        "op6_quality_rules": op6_quality_rules,
        "op7_language_id": op7_language_id,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_line_dedup": op10_line_dedup,
        "op11_collocations": op11_collocations,
        "op12_filter_audit": op12_filter_audit,
        "op13_genetic_packing": op13_genetic_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracles.DECONTAMINATION,
        "op3_substring_dedup": oracles.SUBSTRINGS,
        "op5_url_reputation": oracles.URLS,
        "op10_line_dedup": oracles.LINES,
        "op11_collocations": oracles.COLLOCATIONS,
        "op12_filter_audit": oracles.FILTER_AUDIT,
    }
