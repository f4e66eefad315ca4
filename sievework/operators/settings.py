"""Settings in layers, as rows (layer, path, value): later layers win."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value, layer): the value of the highest layer at each dotted path, and the layer that gave it.

    A higher layer's value at a path hides what lower layers have below it, and its tables replace a lower
    layer's value above them. ``keys`` tell separate settings apart, such as languages.
    """
    own = rows.groupBy(*keys, "path").agg(F.max(F.struct("layer", "value")).alias("top")).select(*keys, "path", "top.layer", "top.value")
    parts = F.split("path", r"\.")
    above = rows.select(*keys, "layer", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), ".").alias("p"), (i < F.size(parts)).alias("inner")))).alias("a"))
    # the highest layer that has a value at a path, and the highest that has one below it
    tops = above.groupBy(*keys, F.col("a.p").alias("p")).agg(F.max(F.when(~F.col("a.inner"), F.col("layer"))).alias("leaf"), F.max(F.when(F.col("a.inner"), F.col("layer"))).alias("table"))
    up = own.select(*keys, "path", "layer", "value", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("p"))
    met = up.join(tops, [*keys, "p"]).withColumn("hidden", F.when(F.col("p") == F.col("path"), F.coalesce(F.col("table"), F.lit(-1)) > F.col("layer")).otherwise(F.coalesce(F.col("leaf"), F.lit(-1)) > F.col("layer")))
    return met.groupBy(*keys, "path", "layer", "value").agg(F.bool_or("hidden").alias("hidden")).where("not hidden").drop("hidden")


def merged_by_name(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lists of named entries (keys, layer, ord, name, value) as one list: entries of a name take the highest layer's value at the first one's place."""
    placed = rows.groupBy(*keys, "name").agg(F.max_by("value", F.struct("layer", "ord")).alias("value"), F.min(F.struct("layer", "ord")).alias("first"))
    return placed.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).alias("ord"), "name", "value")
