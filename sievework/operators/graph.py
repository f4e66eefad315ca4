"""Dependency graphs as edge tables (kind, src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import normal_path
from ..sources.tables import Gathered, drop, marked, stored


def unit_graph(channels: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Edges of all channels (kind, (src, dst)) without self loops and repeats."""
    out = None
    for kind, edges in channels:
        part = edges.select(F.lit(kind).alias("kind"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out.where("src <> dst").distinct()


def resolved_names(wanted: DataFrame, files: DataFrame, folders: Sequence[str], key: str) -> DataFrame:
    """(key, file): the first existing file for each name: ``wanted`` has dir, name and relative; the own folder comes first if relative, else last."""
    search = F.array(*map(F.lit, folders))
    order = F.when(F.col("relative"), F.concat(F.array("dir"), search)).otherwise(F.concat(search, F.array("dir")))
    tried = wanted.select(key, "name", F.posexplode(order).alias("i", "d")).select(key, "i", F.concat("d", F.lit("/"), "name").alias("file"))
    return tried.join(files, "file").groupBy(key).agg(F.min_by("file", "i").alias("file"))


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more; cycles are fine.

    Path doubling: all pairs that are at most ``far`` edges apart, with how many edges. A shortest path of up to twice that many begins with
    one of exactly ``far`` edges, so only these are joined with all, and each such path is found once. The result's rows lie in one stored table a round.
    """
    known = Gathered("closure", most_rounds)
    new, far = known.add(edges.select("src", "dst", F.lit(1).cast("long").alias("n")).distinct()), 1
    for _ in range(most_rounds):
        begun = new.where(F.col("n") == far).select("src", F.col("dst").alias("mid"))
        if begun.isEmpty():
            return known.rows().select("src", "dst")
        step = begun.join(known.rows().select(F.col("src").alias("mid"), "dst", (F.col("n") + far).alias("n")), "mid").groupBy("src", "dst").agg(F.min("n").alias("n"))
        new, far = known.add(step.join(known.rows().select("src", "dst"), ["src", "dst"], "left_anti")), 2 * far
    raise RuntimeError("the closure did not settle")


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000, merged_after: int = 16) -> DataFrame:
    """(root, node) for all nodes that each root reaches, itself included: a stored table. Rounds of joins from the roots outwards; a long chain makes no long plan."""
    out = stored(edges.select("src", "dst").distinct(), "edges")
    seen = Gathered("reachable", merged_after)
    front = seen.add(roots.select("root", F.col("root").alias("node")).distinct())
    for _ in range(most_rounds):
        step = front.join(out, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = seen.add(step.join(seen.rows(), ["root", "node"], "left_anti"))
        if front.isEmpty():
            drop(out)
            return seen.whole()
    raise RuntimeError("the search did not settle")


def dependents(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): which roots reach the given nodes."""
    return reached.join(nodes, "node").select("node", "root")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def normal_edges(edges: DataFrame, base: Column | None = None, fold_case: bool = False) -> DataFrame:
    """Edges (kind, src, dst) between the normal forms of paths, without self loops and repeats; ``base`` is what relative paths begin at."""
    ends = {c: normal_path(F.col(c), base, fold_case) for c in ("src", "dst")}
    return edges.withColumns(ends).where("src <> dst").distinct()


def first_visits(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(forest, node, key, way): where a depth-first walk of each forest comes to a node first; a stored table.

    ``edges``: forest, src, dst, ord, distinct; ``roots``: forest, node, ord. Children are taken in order of ``ord``, a visited node is not walked again. The walk reaches
    a node by the least of all paths without a cycle, orders compared one by one; so each round tries the edges from nodes whose path became less, and keeps
    the least. ``key`` are the orders on that path, ``way`` the nodes before.
    """
    none = F.array().cast(f"array<{roots.schema['node'].dataType.simpleString()}>")
    edges = stored(edges.select("forest", "src", "dst", F.col("ord").cast("long").alias("ord")), "edges")
    known = Gathered("visits")
    front = known.add(roots.groupBy("forest", "node").agg(F.min(F.struct(F.array(F.col("ord").cast("long")).alias("key"), none.alias("way"))).alias("x")))
    for _ in range(most_rounds):
        near = _meeting(edges.withColumnRenamed("src", "node"), front)
        tried = front.join(near, ["forest", "node"]).where(~F.array_contains("x.way", F.col("dst")) & (F.col("dst") != F.col("node")))
        reached = stored(tried.groupBy("forest", F.col("dst").alias("node")).agg(F.min(F.struct(F.concat("x.key", F.array("ord")).alias("key"), F.concat("x.way", F.array("node")).alias("way"))).alias("x")), "reached")
        if reached.isEmpty():
            drop(reached)
            break
        old = _meeting(known.rows(), reached).select("forest", "node", F.lit(None).cast(reached.schema["x"].dataType).alias("x"), F.col("x").alias("old"))
        both = reached.withColumn("old", F.lit(None).cast(reached.schema["x"].dataType)).unionByName(old).groupBy("forest", "node").agg(F.min("x").alias("x"), F.min("old").alias("old"))
        front = known.add(both.where("x is not null and (old is null or x < old)").select("forest", "node", "x"))
        drop(reached)
        if front.isEmpty():
            break
    else:
        raise RuntimeError("the walk did not settle")
    found = stored(known.rows().groupBy("forest", "node").agg(F.min("x").alias("x")).select("forest", "node", "x.key", "x.way"), "first-visits")
    drop(edges, *known.tables)
    return found


def _meeting(rows: DataFrame, those: DataFrame) -> DataFrame:
    """``rows`` of the nodes of ``those``, and of a few others: what a late round cannot meet is dropped before its shuffle."""
    place = F.xxhash64("forest", "node")
    return marked(rows, place, those.select(place.alias("place"))).where("__near").select(*rows.columns)


def rendered_forest(edges: DataFrame, roots: DataFrame, captions: DataFrame) -> DataFrame:
    """(forest, root_ord, line_no, line): each root's tree as text; a node is walked where it comes first, later places say ``(seen)``.

    ``edges``: forest, kind, src, dst, ord (the place among all edges of src); ``roots``: forest, node, ord; ``captions``: forest, node, caption. A root
    that an earlier tree holds is shown with its children again.
    """
    visits = first_visits(edges.select("forest", "src", "dst", "ord").distinct(), roots)
    last = Window.partitionBy("forest", "src").orderBy(F.desc("ord"))
    children = edges.withColumn("last", F.row_number().over(last) == 1)
    again = roots.select("forest", "node", F.array(F.col("ord").cast("long")).alias("key")).join(visits.select("forest", "node", F.col("key").alias("first")), ["forest", "node"]).where("key <> first").select("forest", "node", "key")
    shown = visits.select("forest", "node", "key").unionByName(again)
    placed = shown.withColumnRenamed("node", "src").join(children, ["forest", "src"])
    lines = stored(placed.select("forest", F.concat("key", F.array(F.col("ord").cast("long"))).alias("key"), "kind", "dst", "last", F.col("key").alias("up")), "lines")
    # the bars before a line: for each node between root and line, whether its siblings go on; these are the lines of the key's beginnings
    beginnings = F.when(F.size("up") > 1, F.transform(F.sequence(F.lit(2), F.size("up")), lambda n: F.slice("up", F.lit(1), n)))
    inner = lines.select("forest", F.explode(beginnings).alias("begin"), F.col("key").alias("of")).withColumnRenamed("begin", "key")
    bars = inner.join(lines.select("forest", "key", "last"), ["forest", "key"]).groupBy("forest", F.col("of").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.size("key").alias("n"), "last"))), lambda x: F.when(x["last"], "    ").otherwise("\u2502   ")), "").alias("bars"))
    first = visits.select("forest", F.col("node").alias("dst"), F.col("key").alias("first"))
    named = captions.select("forest", F.col("node").alias("dst"), "caption")
    full = lines.join(bars, ["forest", "key"], "left").join(first, ["forest", "dst"]).join(named, ["forest", "dst"])
    branch = F.when(F.col("last"), "\u2514\u2500 ").otherwise("\u251c\u2500 ")
    text = F.concat(F.coalesce("bars", F.lit("")), branch, F.lit("["), "kind", F.lit("] "), "caption", F.when(F.col("key") == F.col("first"), "").otherwise("  (seen)"))
    heads = roots.select("forest", F.array(F.col("ord").cast("long")).alias("key"), F.col("node").alias("dst")).join(named, ["forest", "dst"])
    rows = full.select("forest", "key", text.alias("line")).unionByName(heads.select("forest", "key", F.concat(F.lit("\u25cf "), "caption", F.lit("  [root]")).alias("line")))
    by = Window.partitionBy("forest", F.col("key")[0]).orderBy("key")
    return rows.select("forest", F.col("key")[0].alias("root_ord"), (F.row_number().over(by) - 1).alias("line_no"), "line")
