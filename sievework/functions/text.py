"""Text expressions: line splitting, trimming, globs and templates."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces and tabs at the end of a line (Spark's rtrim takes spaces only).
TAIL = r"[ \t]+$"


def raw_line(line: Column) -> Column:
    """A line without its carriage return."""
    return F.regexp_replace(line, r"\r+$", "")


def without_tail(line: Column) -> Column:
    return F.regexp_replace(line, TAIL, "")


def matches_from_start(text: Column, pattern: Column) -> Column:
    """Whether ``pattern`` (a column) matches at the start of ``text``; it need not reach the end."""
    return F.rlike(text, F.concat(F.lit("^(?:"), pattern, F.lit(")")))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob on the tail of a path: ``*`` stays within a part, ``**`` spans parts."""
    out = []
    for part in re.split(r"(\*\*/?|\*|\?)", glob.replace("\\", "/")):
        out.append({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)))
    return "(?:^|/)" + "".join(out) + "$"


def interpolate(template: Column, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` placeholders; a template that names anything else stays as it is."""
    filled = template
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    known = "|".join(map(re.escape, values))
    odd = F.rlike(F.regexp_replace(template, r"\{(" + known + r")\}", ""), F.lit(r"\{[^{}]*\}"))
    return F.when(odd, template).otherwise(filled)
