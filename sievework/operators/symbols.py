"""Declarations, references, units and connections: joins, anti joins, having."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals


def repeats(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Every row after the first of its key (E001, LAB001, TAG001, TP004)."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth > 1")


def first_definer(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key: later definitions of a name are not seen."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def unused(declared: DataFrame, references: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """UN001: declarations that nothing refers to; names that begin with an underscore are exempt."""
    return declared.where(~F.startswith(F.col(name), F.lit("_"))).join(references, list(keys), "left_anti")


def undefined(references: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W101, W102, W103, W002, LAB002, TP001: references to what is not declared."""
    return references.join(declared, list(keys), "left_anti")


def resolved(references: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each reference (ref_id, name, scope_id) with the symbol of the innermost enclosing scope, or null.

    ``scopes``: scope_id, ancestors (its own id first, then outwards); ``symbols``: scope_id, name, sym_id.
    """
    chain = references.join(scopes, "scope_id").select("ref_id", "name", F.posexplode("ancestors").alias("up", "at"))
    hit = chain.join(symbols.select(F.col("scope_id").alias("at"), "name", "sym_id"), ["at", "name"])
    nearest = hit.groupBy("ref_id").agg(F.min_by("sym_id", "up").alias("sym_id"))
    return references.join(nearest, "ref_id", "left")


def missing_ports(instances: DataFrame, ports: DataFrame, connections: DataFrame) -> DataFrame:
    """W104: (inst, unit, port) of inputs and outputs that no connection names; inout ports are exempt.

    ``connections`` give a port, or an ``ord`` that stands for the port declared at that place.
    """
    expected = instances.join(ports.where("direction in ('input', 'output')"), "unit").select("inst", "unit", "port")
    by_place = connections.where("port is null").join(instances, "inst").join(ports.select("unit", "ord", F.col("port").alias("p")), ["unit", "ord"]).select("inst", F.col("p").alias("port"))
    given = connections.where("port is not null").select("inst", "port").unionByName(by_place)
    return expected.join(given, ["inst", "port"], "left_anti")


def multi_driven(drivers: DataFrame, keys: Sequence[str] = ("unit", "signal"), ref: str = "ref") -> DataFrame:
    """W105: signals with two or more distinct drivers."""
    return drivers.groupBy(*keys).agg(F.count_distinct(ref).alias("n_drivers")).where("n_drivers >= 2")


def port_effects(connections: DataFrame, ports: DataFrame) -> DataFrame:
    """(unit, signal, effect, ref): what a connection does to a signal by the port's direction.

    Outputs drive, inouts drive and load, inputs and unknown ports load; positional connections only load.
    """
    joined = connections.join(ports.select(F.col("unit").alias("target"), "port", "direction"), ["target", "port"], "left")
    effect = F.when(F.col("port").isNull(), F.array(F.lit("load"))).when(F.col("direction") == "output", F.array(F.lit("drive"))).when(F.col("direction") == "inout", F.array(F.lit("drive"), F.lit("load"))).otherwise(F.array(F.lit("load")))
    return joined.select("unit", "signal", F.explode(effect).alias("effect"), F.col("inst").alias("ref"))


def overrides(defaults: DataFrame, caller: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values in three layers (given, else the caller's, else the default), and whether they changed."""
    joined = defaults.join(caller.withColumnRenamed("value", "from_caller"), list(keys), "left").join(given.withColumnRenamed("value", "from_site"), list(keys), "left")
    value = F.coalesce("from_site", "from_caller", "value")
    return joined.select(*keys, value.alias("value"), (~value.eqNullSafe(F.col("value"))).alias("changed"))


def uncovered_cases(arms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CC001: cases without a default whose arms are not exactly 0 .. 2^w - 1, w being the widest arm.

    ``arms``: the keys, is_default, value (null: not constant), width.
    """
    known = F.bool_and(F.col("value").isNotNull() | F.col("is_default"))
    size = F.pow(F.lit(2), F.max("width")).cast("long")
    full = known & (F.count_distinct("value") == size) & (F.max("value") < size) & (F.min("value") >= 0)
    tested = arms.groupBy(*keys).agg(F.bool_or("is_default").alias("has_default"), full.alias("full"))
    return tested.where("not has_default and not coalesce(full, false)").select(*keys)


def mixed_operators(assigned: DataFrame, keys: Sequence[str], operator: str = "op") -> DataFrame:
    """AW002: (block, signal) assigned with two operators."""
    return assigned.groupBy(*keys).agg(F.count_distinct(operator).alias("n_ops")).where("n_ops > 1")


def visible(uses: DataFrame, declared: DataFrame, scopes: DataFrame) -> DataFrame:
    """Uses (path, name, line and more) with ``symbol`` and ``scope``: the declaration that holds there, or null.

    ``scopes``: path, scope, first, end (nested; end is not within, null runs on); ``declared``: path, name, line, scope, symbol. A declaration holds from its line to the end of
    its scope. Of those that hold the one of the innermost scope counts, of one scope the latest line, then the largest symbol.
    """
    spans = declared.join(scopes, ["path", "scope"]).select("path", "name", F.col("line").alias("first"), "end", F.col("first").alias("opened"), "scope", "symbol")
    inner = F.struct(-F.col("opened"), F.coalesce(F.col("end"), F.lit(intervals.NO_END)), -F.col("first"), -F.col("symbol"))
    found = intervals.best_at(uses, spans, ["path", "name"], "line", inner, F.struct("symbol", "scope"), "__held")
    return found.select(*(F.col(f"`{c}`") for c in uses.columns), F.col("__held.symbol").alias("symbol"), F.col("__held.scope").alias("scope"))
