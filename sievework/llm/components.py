"""Connected components of an edge table, by joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b")


def _large(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u")
    return hung.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that can be reached.

    Alternates the two star contractions until the edge table stays the same; each round
    is stored in place of the one before, so lineage stays short, and so is the result. Self-loops are ignored; nodes without another edge do not
    appear. Both joins have a sum over one key on the other side, so a node
    with very many edges is split by the engine's skew handling.
    """
    edges = stored(_distinct(edges), "edges")
    state = None
    for _ in range(most_rounds):
        last, edges = edges, stored(_distinct(_small(_distinct(_large(edges)))), "edges")
        drop(last)
        r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == (r.n, r.x):
            break
        state = r.n, r.x
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    found = stored(roots.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()), "components")
    drop(edges)
    return found
