"""Operator 12: audit of how filters interact, by a subset-zeta transform.

Each document gets a mask of the filters that it fails; documents are counted by part
and mask. A zeta transform turns a part's counts of masks into sums over the subsets of every mask,
so the number of survivors of any set of filters is one entry. What a
filter removes at its step of an order is the difference of two neighbouring
sets; sums over labels go through the same transform.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop, stored

_SPACE = r"[\x20\x09-\x0D]+"


def mask_counts(flagged: DataFrame, filters: Sequence[str], part_col: str, marks: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(part, mask, n, one sum per mark): rows by part (null: empty) and by which boolean columns ``filters`` hold; bit i is filter i.

    ``weight`` counts a row several times.
    """
    mask = sum((F.shiftleft(column(f).cast("int"), i) for i, f in enumerate(filters)), F.lit(0))
    n = F.lit(1) if weight is None else weight
    sums = [F.sum(F.when(column(m), n).otherwise(0)).alias(m) for m in marks]
    return flagged.groupBy(F.coalesce(column(part_col), F.lit("")).alias("part"), mask.alias("mask")).agg(F.sum(n).cast("long").alias("n"), *sums)


def subset_sums(counts: DataFrame, n_filters: int, marks: Sequence[str] = ()) -> DataFrame:
    """One row per part: arrays ``n`` and one per mark; entry s is the sum over all masks within s."""
    names = ["n", *marks]
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("found")  # 2^n_filters entries at most
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))

    def listed(c: str) -> Column:
        return F.transform(every, lambda s: F.coalesce(F.try_element_at("found", s)[c], F.lit(0)).cast("long")).alias(c)

    def summed(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, s: x + F.when(s.bitwiseAND(bit) != 0, F.get(F.col(c), s - bit)).otherwise(0))

    out = counts.groupBy("part").agg(by_mask).select("part", *map(listed, names))
    for i in range(n_filters):
        out = out.withColumns({c: summed(c, 1 << i) for c in names})
    return out


def audit_orders(sums: DataFrame, letters: str, marks: Mapping[str, str] = {}) -> DataFrame:
    """One row per part, order of the filters ``letters`` and step, from ``subset_sums``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, one per mark (named by
    ``marks``: what the step removes of it), shapley (what the step's filter removes, summed over all orders).
    All orders are listed, so there may be seven filters at most.
    """
    k = len(letters)
    if not 0 < k <= 7 or len(set(letters)) < k:
        raise ValueError("one to seven filters, each with its own letter")
    full = (1 << k) - 1
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.position(x, F.lit(letters)) - 1).cast("int"))
    steps = sums.withColumn("filter_order", F.explode(orders)).withColumn("bits", bits)
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("bit", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    survivors = lambda c, s: F.get(F.col(c), F.lit(full) - s)  # noqa: E731  those that fail no filter of s
    lost = lambda c, s: survivors(c, s) - survivors(c, s + F.col("bit"))
    weights = F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)).cast("long") for i in range(k)))
    others = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda a, s: a + F.get(weights, F.bit_count(s)) * lost("n", s))
    removed = lost("n", F.col("before"))
    return steps.select(
        "part", "filter_order", "step", survivors("n", F.col("before") + F.col("bit")).alias("kept"), removed.alias("removed"),
        (F.get("n", F.lit(full)) - survivors("n", F.col("bit")) - removed).alias("redundant"), (F.get("n", "bit") - F.get("n", F.lit(0))).alias("unique_fails"),
        *(lost(m, F.col("before")).alias(name) for m, name in marks.items()), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10) -> DataFrame:
    """The audit of five filters on whole texts, with what they cost in ``labels`` (quality 1, toxic 1).

    A document fails A with fewer than ``least_words`` words, B if less than ``distinct_percent`` of 100 words differ,
    C if more than ``upper_percent`` of 100 characters are A-Z, D if it holds any of ``#$%&*|``, E if its text is that of a
    smaller id. A null text is an empty text. A null id is neither smaller nor larger than others, so it never fails E, and
    has no labels; of rows that share the smallest id of a text none fails E. An id is good or toxic if any of
    its labels says so, and each of its rows counts. A null part is the empty string. Other columns are ignored; an empty table gives no rows.
    """
    text = docs.select(column(id_col).alias("id"), F.coalesce(column(part_col), F.lit("")).alias("part"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    rows = words.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("key"),
        (F.size("words") < least_words).alias("A"), (100 * F.size(F.array_distinct("words")) < distinct_percent * F.size("words")).alias("B"),
        (100 * upper > upper_percent * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    flags = ["A", "B", "C", "D"]
    rows = stored(rows.groupBy("id", "part", "key", *flags).agg(F.count("*").alias("rows")), "flagged")  # one row for a hot id or text with nothing else
    first = rows.where("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["key", "id"], "left")  # the id is part of the key, so a text that very many have is spread
    flagged = marked.withColumn("E", F.col("id").isNotNull() & F.col("first").isNull()).groupBy("id", "part", *flags, "E").agg(F.sum("rows").alias("rows"))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    both = flagged.join(known, "id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")})
    counts = stored(mask_counts(both, [*flags, "E"], "part", ["good", "toxic"], F.col("rows")), "masks")
    drop(rows)
    return audit_orders(subset_sums(counts, 5, ["good", "toxic"]), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
