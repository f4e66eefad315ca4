"""Bit widths of declarations, literals and operators, as column expressions. Null means undecidable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]+$")), text.try_cast("long"))


def width_of_range(text: Column) -> Column:
    """Width of a range: none is 1, ``n`` is n + 1, ``m:l`` is |m - l| + 1."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\[\]]", "")
    high, low = _number(F.split_part(t, F.lit(":"), F.lit(1))), _number(F.split_part(t, F.lit(":"), F.lit(2)))
    return F.when(t == "", F.lit(1).cast("long")).when(F.instr(t, ":") == 0, high + 1).otherwise(F.abs(high - low) + 1)


def width_of_literal(text: Column) -> Column:
    """Width of a literal: its size if it has one; 0 for zero and fill constants; the bits it needs otherwise."""
    t = F.replace(text, F.lit("_"), F.lit(""))
    size = F.regexp_extract(t, r"^\s*([0-9]+)\s*'", 1)
    fill = F.rlike(t, F.lit(r"^'[01xzXZ]$"))
    value = _number(F.trim(t))
    bits = F.when(value == 0, 0).when(value > 0, F.length(F.bin(value))).cast("long")
    return F.when(size != "", size.try_cast("long")).when(fill, F.lit(0).cast("long")).otherwise(bits)


#: Operators by how their width follows from those of their sides.
ONE_BIT = ("==", "!=", "===", "!==", "<", "<=", ">", ">=", "&&", "||")
SHIFTS = ("<<", ">>", "<<<", ">>>")
LARGER = ("+", "-", "*", "/", "%", "**", "&", "|", "^", "~^", "^~")


def width_of_binary(operator: Column, left: Column, right: Column) -> Column:
    """Comparisons and logic give 1, shifts the left width, arithmetic and bit operators the larger of two known widths, others none."""
    one, shift, larger = operator.isin(*ONE_BIT), operator.isin(*SHIFTS), operator.isin(*LARGER)
    return F.when(one, F.lit(1).cast("long")).when(shift, left).when(larger & left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def width_of_repeat(times: Column, width: Column) -> Column:
    return times.cast("long") * width


def width_of_select(text: Column) -> Column:
    """Width of a select: [i] is 1, [h:l] is |h - l| + 1, [b +: w] and [b -: w] are w."""
    t = F.regexp_replace(text, r"[\s\[\]]", "")
    part = F.regexp_extract(t, r"[+-]:([0-9]+)$", 1)
    return F.when(F.rlike(t, F.lit(r"[+-]:")), _number(part)).when(F.instr(t, ":") > 0, width_of_range(t)).otherwise(F.lit(1).cast("long"))


def width_of_concat(widths: Column) -> Column:
    """Sum of an array of widths; null if any is unknown."""
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)


def width_of_choice(left: Column, right: Column) -> Column:
    """The larger branch; null if either is unknown (greatest alone would skip nulls)."""
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def is_parameterized(text: Column) -> Column:
    return F.rlike(text, F.lit("[A-Za-z]"))


def root_signal(target: Column) -> Column:
    """The signal that an assignment target names first."""
    return F.regexp_extract(target, r"^\s*\{?\s*([A-Za-z_][A-Za-z0-9_$]*)", 1)
