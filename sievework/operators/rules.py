"""Declarative rules on symbols, and tallies of what they find."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, interpolate, matches_from_start


@dataclass(frozen=True)
class NamingRule:
    """A symbol of ``kind`` must match ``pattern`` from its start."""

    id: str
    kind: str
    pattern: str
    message: str
    severity: str = "warning"
    default: bool = True


@dataclass(frozen=True)
class UserConfig:
    """``enabled`` is exclusive; without it a rule named in ``severities`` or ``per_file`` is on even if it is off by default."""

    enabled: Sequence[str] | None = None
    severities: Mapping[str, str] | None = None
    per_file: Mapping[str, Sequence[str]] | None = None


def active_rules(rules: Sequence[NamingRule], user: UserConfig) -> list[NamingRule]:
    severities, per_file = user.severities or {}, user.per_file or {}
    if user.enabled is not None:
        wanted = set(user.enabled)
    else:
        wanted = {r.id for r in rules if r.default} | set(severities) | {x for ids in per_file.values() for x in ids}
    return [replace(r, severity=severities.get(r.id, r.severity)) for r in rules if r.id in wanted]


def rule_table(spark: SparkSession, rules: Sequence[NamingRule]) -> DataFrame:
    rows = [(r.id, r.kind, r.pattern, r.message, r.severity) for r in rules]
    return spark.createDataFrame(rows, "id string, kind string, pattern string, template string, severity string")


def naming_violations(symbols: DataFrame, rules: Sequence[NamingRule], user: UserConfig = UserConfig()) -> DataFrame:
    """(path, name, kind, id, severity, message) of symbols (path, name, kind) that break an active rule.

    ``per_file`` maps a glob on paths to the rules that are off there. The rules come from configuration, so
    their join is on a table of a few rows; a null name breaks no rule.
    """
    found = symbols.join(F.broadcast(rule_table(symbols.sparkSession, active_rules(rules, user))), "kind").where(~matches_from_start(F.col("name"), F.col("pattern")))
    for glob, ids in (user.per_file or {}).items():
        found = found.where(~(F.rlike("path", F.lit(glob_pattern(glob))) & F.col("id").isin(*ids)))
    values = {c: F.col(c) for c in ("name", "kind", "pattern", "id", "severity")}
    return found.select("path", "name", "kind", "id", "severity", interpolate(F.col("template"), values).alias("message"))


def suffix_conflicts(symbols: DataFrame, suffixes: DataFrame, of: str) -> DataFrame:
    """NC014 to NC016: names with a suffix that stands for another value of ``of``. ``suffixes``: suffix, meaning.

    The suffixes come from configuration; they are what is broadcast, and names are cut only to the lengths that suffixes have.
    """
    lengths = suffixes.where("suffix <> ''").agg(F.collect_set(F.length("suffix")).alias("__lengths"))
    fitting = F.filter("__lengths", lambda i: i <= F.length("name"))
    tails = symbols.join(F.broadcast(lengths)).withColumn("suffix", F.explode(F.transform(fitting, lambda i: F.expr("name").substr(-i, i)))).drop("__lengths")
    return tails.join(F.broadcast(suffixes), "suffix").where(F.col(of) != F.col("meaning")).drop("suffix", "meaning").distinct()


def severity_tally(diagnostics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Errors, warnings and notes per key."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return diagnostics.groupBy(*keys).agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
