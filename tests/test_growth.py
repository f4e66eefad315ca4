"""What must not grow with the input: broadcasts of exploded rows, shuffles of a result, one wide value that ends a query."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sievework.operators import directives, graph, intervals, layout, linemap, ports, rules
from sievework.plans import wiring
from sievework.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_covering_spans_broadcast_nothing(spark):
    """Tables of known small size: Spark takes what explode makes of them for as small, and before broadcast it."""
    n = F.col("id")
    spans = spark.range(50).select((n % 5).alias("path"), n.alias("node"), (n % 7).alias("first"), (n % 7 + n).alias("end"))
    edits = spark.range(5).select(n.alias("path"), (n + 3).alias("edit_first"), (n + 5).alias("edit_end"))
    found = linemap.covering_spans(spans, edits)
    assert "BroadcastHashJoin" not in plan_of(found)
    want = sorted((k % 5, k) for k in range(50) if k % 7 <= k % 5 + 3 < k % 7 + k and k % 5 + 5 <= k % 7 + k)
    assert sorted((r.path, r.node) for r in found.collect()) == want


def test_suffixes_are_what_is_broadcast(spark):
    n = F.col("id")
    names = spark.range(60).select(n.alias("id"), F.concat(F.lit("n"), n.cast("string")).alias("name"), F.when(n % 2 == 0, "even").otherwise("odd").alias("of"))
    table = spark.createDataFrame([("1", "odd"), ("12", "even"), ("2", "odd"), ("", "none"), ("longer than any", "x")], "suffix string, meaning string")
    found = rules.suffix_conflicts(names, table, "of")
    assert "BuildLeft" not in plan_of(found)
    assert sorted(r.id for r in found.collect()) == [2, 12, 22, 32, 42, 52]
    rule = rules.NamingRule("R", "k", "n1", "{name}")
    kinds = names.select(F.lit("p").alias("path"), "name", F.lit("k").alias("kind"))
    broken = rules.naming_violations(kinds, [rule])
    assert "BuildLeft" not in plan_of(broken) and broken.count() == 49


def test_constants_beyond_64_bits_are_unknown(spark, tmp_path):
    rows = [(149_999, 7, 105), (901, 1, 105)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    wide, plain = sorted(wiring.constant_arithmetic(spark, str(tmp_path)).collect(), key=lambda r: -r.k)
    assert all(v is None for c, v in wide.asDict().items() if c not in ("k", "n"))
    assert (plain.added, plain.product, plain.negative, plain.shifted) == (133, 640, -128, 4096)


def test_instance_widths_end_with_the_join_of_names(spark):
    instances = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "inst long, unit string")
    declared = spark.createDataFrame([("u", "a", "W-1:0"), ("u", "b", "W-1:0"), ("u", "c", None), ("u", "d", ""), ("v", "a", "[7 : 4]"), ("v", "e", "X")], "unit string, name string, width_expr string")
    defaults = spark.createDataFrame([("u", "W", "8")], "unit string, param string, value string")
    given = spark.createDataFrame([(2, "W", "4")], "inst long, param string, value string")
    found = ports.instance_widths(instances, declared, defaults, given)
    above = plan_of(found).split("SortMergeJoin")[0]
    assert "Aggregate" not in above and "Exchange" not in above
    assert sorted((r.inst, r.name, r.width) for r in found.collect()) == [(1, "a", 8), (1, "b", 8), (1, "c", 1), (1, "d", 1), (2, "a", 4), (2, "b", 4), (2, "c", 1), (2, "d", 1), (3, "a", 4), (3, "e", None)]


def test_outside_takes_a_point_through_one_shuffle(spark):
    """Intervals over several stretches of 2^16, within one, at borders and without an end; points are never copied by level."""
    s = 1 << 16
    spans = [("a", 5, 9), ("a", s - 2, s + 3), ("a", 2 * s, 3 * s), ("a", 4 * s - 1, 7 * s + 1), ("b", s, s), ("b", 9 * s + 5, None), (None, 0, None), ("c", None, 5)]
    places = sorted({max(0, x + d) for _, a, b in spans for x in (a, b) if x is not None for d in (-1, 0, 1)} | {5 * s, 20 * s, None}, key=str)
    points = [(k, p, i) for k in ("a", "b", "c", None) for i, p in enumerate(places)]
    df = spark.createDataFrame(points, "path string, line long, id int")
    found = intervals.outside(df, spark.createDataFrame(spans, "path string, first long, end long"), ["path"], "line")
    held = lambda k, p: p is not None and any(k is not None and k == x and a is not None and a <= p and (b is None or p < b) for x, a, b in spans)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(x) for x in points if not held(*x[:2]))
    assert "explode(array(struct" not in plan_of(found) and found.columns == ["path", "line", "id"]


def test_silenced_ranges_are_found_once(spark):
    """What finds the ranges (here a function that counts its calls) runs for them once, not once for each use."""
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    ranges = spark.createDataFrame([("a", 1, 3, None), ("a", 5, None, ["X"])], "path string, first int, end int, codes array<string>").coalesce(1)
    found = spark.createDataFrame([("a", n, c) for n in (0, 1, 3, 6) for c in "XY"], "path string, line int, code string")
    left = directives.not_silenced(found, ranges.mapInArrow(counted, ranges.schema))
    assert sorted((r.line, r.code) for r in left.collect()) == [(0, "X"), (0, "Y"), (3, "X"), (3, "Y"), (6, "Y")]
    assert calls.value == 2


def test_wrapping_is_compiled_and_greedy(spark):
    rng = random.Random(7)
    texts = [" " * rng.randrange(0, 90, 7) + "//" + "".join(rng.choice(["a", "bc", "\U0001f600", "x" * 30, "y" * 95]) + rng.choice([" ", "  ", "\t"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path string, line_no int, raw string")
    want = []
    for i, t in enumerate(texts):
        lead, parts = t[: len(t) - len(t.lstrip())], [[]]
        for w in t.lstrip()[2:].split():
            if parts[-1] and len(" ".join([*parts[-1], w])) > 80 - len(lead) - 3:
                parts.append([])
            parts[-1].append(w)
        want += [(i, j, lead + "// " + " ".join(x)) for j, x in enumerate(parts)] if len(t) > 80 else [(i, 0, t)]
    found = layout.wrapped(df, 80)
    assert sorted((r.line_no, r.part_no, r.part) for r in found.collect()) == want
    assert "lambda" not in plan_of(found)


def test_port_drivers_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(tables, "stored", kept := (lambda df, name, real=tables.stored: plans.append(plan_of(df)) or real(df, name)))
    monkeypatch.setattr(ports, "stored", kept)
    n = F.col("id")
    own = spark.range(2, 3).select(n.alias("unit"), n.alias("signal"), F.lit("assign").alias("ref"))
    links = spark.range(2).select(n.alias("unit"), n.alias("signal"), (n + 10).alias("inst"), (n + 1).alias("target"), (n + 1).alias("port"))
    declared = spark.range(3).select(n.alias("unit"), n.alias("port"))
    found = ports.port_drivers(own, links, declared)
    assert sorted((r.unit, r.port, r.ref, r.via) for r in found.collect()) == [(0, 0, "assign", 2), (1, 1, "assign", 1), (2, 2, "assign", 0)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_closure_writes_each_pair_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tables, "stored", lambda df, name, real=tables.stored: written.append(real(df, name)) or written[-1])
    rng = random.Random(4)
    edges = {(i, i + 1) for i in range(21)} | {(30 + i, 30 + (i + 1) % 9) for i in range(9)} | {(rng.randrange(50, 75), rng.randrange(50, 75)) for _ in range(40)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    found = graph.closure(spark.createDataFrame(sorted(edges), "src int, dst int"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and found.columns == ["src", "dst"]
    assert sum(t.count() for t in written) == len(want)
    assert graph.closure(spark.createDataFrame([], "src int, dst int")).isEmpty()


def test_first_visits_write_what_became_less_only(spark, monkeypatch):
    written = []

    def counted(df, name, real=tables.stored):
        written.append((name, (found := real(df, name)).count()))
        return found

    monkeypatch.setattr(tables, "stored", counted)
    monkeypatch.setattr(graph, "stored", counted)
    edges = [(1, n, n + 1, 0) for n in range(9)] + [(1, 0, 9, 1), (1, 9, 0, 0), (2, 5, 6, 0)]
    found = graph.first_visits(spark.createDataFrame(edges, "forest int, src int, dst int, ord int"), spark.createDataFrame([(1, 0, 0), (2, 5, 0)], "forest int, node int, ord int"))
    got = {(r.forest, r.node): (r.key, r.way) for r in found.collect()}
    assert got == {(1, n): ([0] * (n + 1), list(range(n))) for n in range(10)} | {(2, 5): ([0], []), (2, 6): ([0, 0], [5])}
    assert sum(n for name, n in written if name == "visits") == 13
