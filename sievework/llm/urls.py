"""Operator 5: URL filter by rules and by empirical-Bayes host reputation.

Built-in functions only. Labelled pages give each host a count of outcomes and a
count of bad ones. A host's bad rate is shrunk towards that of its registered
domain, the domain's towards its suffix, the suffix's towards the whole; how far,
each level's spread decides (a beta-binomial moment estimate). A host is blocked
when the lower posterior bound of its bad rate exceeds a multiple of the bad rate of all
outcomes, so that it is surely worse than the average host.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels under which country domains are registered, where no suffix table is given: co.uk, com.mx, ac.in.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "or", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


@dataclass(frozen=True)
class Reputation:
    """z: normal quantile of the posterior bound. lift: a host is blocked when the bound exceeds so many times the bad
    rate of all outcomes. least_strength, most_strength: how many outcomes the prior may count for.
    """

    z: float = 1.645
    lift: float = 1.0
    least_strength: float = 1.0
    most_strength: float = 100.0


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public suffix file: one a line, ``*.`` for any label, ``!`` for an exception, ``//`` before comments.

    Columns: key (what a host must end with), labels (how many labels the suffix then has), exception.
    """
    rule = F.lower(F.trim(F.element_at(F.split("value", r"\s"), 1)))
    rules = spark.read.text(path).where(F.trim("value") != "").where("not startswith(trim(value), '//')").select(rule.alias("rule"))
    n = F.size(F.split("rule", r"\."))
    wild, exception = F.startswith("rule", F.lit("*.")), F.startswith("rule", F.lit("!"))
    return rules.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("key"), F.when(exception, n - 1).otherwise(n).alias("labels"), exception.alias("exception")).distinct()


def with_suffix(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """``hosts`` (one row per host) with domain and suffix: the longest rule of ``suffixes`` that fits, an exception before others, else the last label.

    A host that is itself a suffix is its own domain. Without a table, country domains have two labels where the second is one of SECOND_LEVEL.
    """
    if suffixes is None:
        tld, second = F.substring_index("host", ".", -1), F.element_at(F.split(F.substring_index("host", ".", -2), r"\."), 1)
        cut = hosts.withColumn("labels", F.when((F.length(tld) == 2) & second.isin(*SECOND_LEVEL), 2).otherwise(1))
    else:
        tails = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("i")).select("host", "i", F.expr("substring_index(host, '.', -i)").alias("key"))
        fit = tails.join(suffixes, "key").where("labels <= i or not exception").groupBy("host").agg(F.max(F.struct("exception", "labels")).alias("best"))
        cut = hosts.join(fit, "host", "left").withColumn("labels", F.coalesce("best.labels", F.lit(1))).drop("best")
    return cut.withColumn("suffix", F.expr("substring_index(host, '.', -labels)")).withColumn("domain", F.expr("substring_index(host, '.', -labels - 1)")).drop("labels")


def matched_rule(host_: Column, path_: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict.

    The rules are written out in the expression, which suits lists up to about a
    thousand entries; ``joined_rules`` takes any number.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):  # the longest last, so outermost
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def joined_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) for each distinct host and path of ``pages`` that a rule (verdict, host, path) fits: the longest, as in ``matched_rule``.

    A host's tails, label by label, are keys of the join. Of two rules that differ in their verdict only the larger verdict counts.
    """
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    known = rules.select(F.col("host").alias("tail"), F.col("path").alias("begin"), "verdict")
    fits = pages.select("host", "path").distinct().withColumn("tail", F.explode(F.array_distinct(tails))).join(known, "tail").where(F.startswith("path", F.col("begin")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("tail") + F.length("begin")).alias("size"), "tail", "begin", "verdict")).alias("b"))
    return best.select("host", "path", F.concat("b.tail", "b.begin").alias("rule"), F.col("b.verdict").alias("rule_verdict"))


def _strength(groups: DataFrame, rate: float, p: Reputation) -> float:
    """The beta prior's strength from the spread of bad rates between groups (one row comes back)."""
    g = groups.where("n > 0").agg(
        F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.pow(F.col("k") - rate * F.col("n"), F.lit(2)) / F.col("n")).alias("s"),
    ).first()
    if not g.c or g.c < 2 or not 0 < rate < 1:
        return p.most_strength
    spare = g.n - g.nn / g.n - (g.c - 1)
    if spare <= 0:
        return p.most_strength
    rho = (g.s / (rate * (1 - rate)) - (g.c - 1)) / spare
    return min(p.most_strength, max(p.least_strength, 1 / rho - 1)) if rho > 0 else p.most_strength


def host_reputation(counts: DataFrame, p: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of each host's bad rate from ``counts`` (host, n outcomes, k bad ones; one row per host).

    Columns: host, n, k, mean, bound, blocked. A host without outcomes takes its
    domain's rate; without any outcomes at all nothing is blocked.
    """
    hosts = stored(with_suffix(counts.select("host", "n", "k"), suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = whole.k / whole.n if whole.n else 0.0
    m_top, m_domain, m_host = (_strength(g, rate, p) for g in (tops, domains, hosts))
    shrunk = lambda m, prior: (m * prior + F.col("k")) / (m + F.col("n"))
    tops = tops.select("suffix", shrunk(m_top, F.lit(rate)).alias("prior"))
    domains = domains.join(tops, "suffix").select("domain", shrunk(m_domain, F.col("prior")).alias("prior"))
    a, b = m_host * F.col("prior") + F.col("k"), m_host * (1 - F.col("prior")) + F.col("n") - F.col("k")
    mean = a / (a + b)
    bound = mean - p.z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, "domain").select("host", "n", "k", mean.alias("mean"), bound.alias("bound"), F.coalesce(bound > p.lift * rate, F.lit(False)).alias("blocked"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] | DataFrame, p: Reputation = Reputation(), suffixes: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row of ``pages``: id, host, path, rule, verdict.

    ``outcomes`` has ``id_col`` and ``bad`` (0 or 1; several rows of an id count as
    one, bad if any is; null outcomes and ids are left out). The longest fitting rule
    decides (``rules`` may be a table of verdict, host and path, of any size); else the host's reputation. A null url, or one without ``://``, has an
    empty host and path, which no outcome speaks about: it is allowed. Repeated rows are
    judged, and counted, each on their own. An empty table gives no rows.
    """
    named = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    outcomes = outcomes.where(F.col("bad").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("bad").alias("bad"))
    counts = named.where("host <> ''").join(outcomes, id_col, "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    blocked = host_reputation(counts, p, suffixes).where("blocked").select("host", F.lit("block").alias("learned"))
    if isinstance(rules, DataFrame):
        named = named.join(joined_rules(named, rules), ["host", "path"], "left")
        rule, verdict = F.col("rule"), F.col("rule_verdict")
    else:
        rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return named.join(blocked, "host", "left").select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("learned"), F.lit("allow")).alias("verdict")
    )
