"""Operators on small fact tables, against expectations written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.functions import text, widths
from sievework.operators import changes, directives, graph, layout, lines, rules, symbols
from sievework.sources import tables
from sievework.streaming import changes as streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_lines_and_style(spark):
    source = "a  \r\n\tb\t\nc\td\n \n" + "x" * 101 + "\n"
    found = lines.lines(spark.createDataFrame([("f", source), ("g", "")], "p string, t string"), "p", "t")
    assert found.count() == 7
    assert rows(lines.trailing_space(found), "line_no", "first", "end") == [(0, 1, 3), (1, 2, 3), (3, 0, 1)]
    assert rows(lines.tabs(found), "line_no", "first") == [(1, 0), (2, 1)]
    assert rows(lines.wide_lines(found), "line_no", "end") == [(4, 101)]
    assert lines.wide_lines(found, 0).count() == 0
    assert lines.style(found).count() == 6


def test_joined_lines_and_tokens(spark):
    found = lines.lines(spark.createDataFrame([("f", "a \\\nb\\\nc\nd (e [f) << 12.5")], "p string, t string"), "p", "t")
    assert rows(lines.joined_lines(found), "line_no", "raw") == [(0, "a bc"), (3, "d (e [f) << 12.5")]
    tokens = lines.tokens(found.where("line_no = 3"), spark.createDataFrame([("e", "keyword.e")], "content string, type string"))
    assert rows(tokens, "content", "type") == sorted([("d", "id"), ("(", "symbol"), ("e", "keyword.e"), ("[", "symbol"), ("f", "id"), (")", "symbol"), ("<<", "symbol"), ("12.5", "literal.number")])
    depth = {r.content: r.depth for r in lines.bracket_depth(tokens).collect()}
    assert depth["d"] == 0 and depth["f"] == 2 and depth["<<"] == 1
    tags = spark.createDataFrame([("f", "b", 1), ("f", "b", -1), ("f", "p", 1)], "path string, tag string, step int")
    assert rows(lines.unbalanced(tags)) == [("f", "p", 1, 0)]


def test_directives(spark):
    found = lines.lines(spark.createDataFrame([("f", "  `define A 1\n`undef A\n`define A 2\n x")], "p string, t string"), "p", "t")
    assert rows(directives.directive_lines(found, "`"), "line_no", "name", "rest") == [(0, "define", "A 1"), (1, "undef", "A"), (2, "define", "A 2")]
    events = [("f", "A", 1, "define", "1"), ("f", "A", 2, "define", "2"), ("f", "A", 3, "undef", None), ("f", "A", 4, "define", "3"), ("f", "A", 5, "define", None), ("f", "A", 6, "define", "4"), ("f", "A", 7, "define", "4")]
    e = spark.createDataFrame(events, "path string, name string, seq int, op string, value string")
    assert rows(directives.redefinitions(e), "seq", "value", "last_value") == [(2, "2", "1")]
    assert rows(directives.last_values(e.where("seq < 3"), "1")) == [("f", "2")]


def test_macros_in_force(spark):
    events = spark.createDataFrame([("f", "M", 1, 1, ["a", "b"]), ("f", "M", 5, 2, None), ("f", "M", 7, 3, ["a", "..."]), ("f", "M", 7, 4, []), ("f", "N", 1, 5, ["a", "..."])], "path string, name string, line int, seq int, params array<string>")
    calls = [("f", "M", 0, 2, False), ("f", "M", 1, 2, False), ("f", "M", 2, 3, False), ("f", "M", 6, 1, False), ("f", "M", 7, 1, True), ("f", "M", 8, 1, False), ("f", "N", 2, 1, False), ("f", "N", 3, 0, False), ("g", "M", 9, 1, False)]
    c = spark.createDataFrame(calls, "path string, name string, line int, slots int, single_empty boolean")
    placed = directives.in_force(c, events)
    assert rows(placed, "name", "line") == [("M", 1), ("M", 2), ("M", 6), ("M", 7), ("M", 8), ("N", 2), ("N", 3)]
    assert rows(directives.wrong_argument_counts(placed), "name", "line") == [("M", 2), ("M", 8), ("N", 3)]


def test_suppression(spark):
    marks = spark.createDataFrame([("f", 2, "off"), ("f", 3, "off"), ("f", 5, "on"), ("f", 8, "off"), ("g", 1, "on")], "path string, line int, op string")
    ranges = directives.suppressed_ranges(marks)
    assert rows(ranges) == [("f", 2, 5), ("f", 8, None)]
    found = spark.createDataFrame([("f", x) for x in (1, 2, 4, 5, 7, 8, 99, None)] + [("g", 1)], "path string, line int")
    assert rows(directives.unsuppressed(found, ranges)) == sorted([("f", 1), ("f", 5), ("f", 7), ("f", None), ("g", 1)], key=str)


def test_symbols(spark):
    declared = spark.createDataFrame([("u", "a", 1), ("u", "a", 2), ("u", "b", 3), ("u", "_c", 4)], "unit string, name string, ord int")
    assert rows(symbols.repeats(declared, ["unit", "name"], ["ord"]), "ord") == [(2,)]
    assert rows(symbols.first_definer(declared, ["unit", "name"], ["ord"]), "ord") == [(1,), (3,), (4,)]
    used = spark.createDataFrame([("u", "a"), ("u", "z")], "unit string, name string")
    assert rows(symbols.unused(declared, used, ["unit", "name"]), "name") == [("b",)]
    assert rows(symbols.undefined(used, declared, ["unit", "name"]), "name") == [("z",)]
    scopes = spark.createDataFrame([(1, [1]), (2, [2, 1]), (3, [3, 2, 1])], "scope_id int, ancestors array<int>")
    table = spark.createDataFrame([(1, "x", 10), (2, "x", 20), (1, "y", 30)], "scope_id int, name string, sym_id int")
    references = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "y", 3), (4, "q", 2)], "ref_id int, name string, scope_id int")
    assert rows(symbols.resolved(references, scopes, table), "ref_id", "sym_id") == [(1, 20), (2, 10), (3, 30), (4, None)]


def test_ports_and_drivers(spark):
    ports = spark.createDataFrame([("U", "a", 0, "input"), ("U", "b", 1, "output"), ("U", "c", 2, "inout")], "unit string, port string, ord int, direction string")
    instances = spark.createDataFrame([("i1", "U"), ("i2", "U")], "inst string, unit string")
    connections = spark.createDataFrame([("i1", "a", None), ("i2", None, 1)], "inst string, port string, ord int")
    assert rows(symbols.missing_ports(instances, ports, connections), "inst", "port") == [("i1", "b"), ("i2", "a")]
    wired = spark.createDataFrame([("T", "s", "U", "b", "i1"), ("T", "s", "U", "c", "i2"), ("T", "s", "U", None, "i3"), ("T", "r", "V", "q", "i4")], "unit string, signal string, target string, port string, inst string")
    effects = symbols.port_effects(wired, ports)
    assert rows(effects, "signal", "effect", "ref") == [("r", "load", "i4"), ("s", "drive", "i1"), ("s", "drive", "i2"), ("s", "load", "i2"), ("s", "load", "i3")]
    assert rows(symbols.multi_driven(effects.where("effect = 'drive'"))) == [("T", "s", 2)]


def test_layers_cases_and_operators(spark):
    layer = lambda *x: spark.createDataFrame(list(x), "k string, value string")
    got = symbols.overrides(layer(("a", "1"), ("b", "2"), ("c", "3")), layer(("b", "9"), ("c", "3")), layer(("b", "8")), ["k"])
    assert rows(got) == [("a", "1", False), ("b", "8", True), ("c", "3", False)]
    arms = [("full", False, 0, 1), ("full", False, 1, 1), ("open", False, 0, 2), ("open", False, 1, 2), ("odd", False, 0, 1), ("odd", False, None, 1), ("dflt", False, 0, 4), ("dflt", True, None, None)]
    assert rows(symbols.uncovered_cases(spark.createDataFrame(arms, "c string, is_default boolean, value int, width int"), ["c"])) == [("odd",), ("open",)]
    assigned = spark.createDataFrame([("b", "s", "="), ("b", "s", "<="), ("b", "t", "=")], "block string, signal string, op string")
    assert rows(symbols.mixed_operators(assigned, ["block", "signal"])) == [("b", "s", 2)]


def test_rules(spark):
    table = [rules.NamingRule("A", "wire", "[a-z]+$", "{name} of {kind}"), rules.NamingRule("B", "wire", "x", "no", default=False), rules.NamingRule("C", "reg", "r_", "{odd}")]
    ids = lambda **k: [r.id for r in rules.active_rules(table, rules.UserConfig(**k))]
    assert ids() == ["A", "C"] and ids(enabled=["B"]) == ["B"] and ids(per_file={"*.v": ["B"]}) == ["A", "B", "C"]
    found = spark.createDataFrame([("d/a.v", "Bad", "wire"), ("d/a.v", "good", "wire"), ("e/b.v", "Bad", "wire"), ("e/b.v", "q", "reg"), ("e/b.v", None, "reg")], "path string, name string, kind string")
    user = rules.UserConfig(severities={"C": "error"}, per_file={"d/*.v": ["A"]})
    got = rules.naming_violations(found, table, user)
    assert rows(got, "path", "id", "severity", "message") == [("e/b.v", "A", "warning", "Bad of wire"), ("e/b.v", "C", "error", "{odd}")]
    assert rows(rules.severity_tally(got)) == [(1, 1, 0)]
    suffixes = spark.createDataFrame([("_i", "input"), ("_o", "output")], "suffix string, meaning string")
    ports = spark.createDataFrame([("a_i", "input"), ("b_o", "input")], "name string, direction string")
    assert rows(rules.suffix_conflicts(ports, suffixes, "direction")) == [("b_o", "input")]


@pytest.mark.parametrize(("glob", "path", "fits"), [("a/*.v", "x/a/b.v", True), ("a/*.v", "a/c/b.v", False), ("a/**/b.v", "a/b.v", True), ("a/**/b.v", "z/a/c/d/b.v", True), ("b?.v", "b1.v", True), ("b.v", "ab.v", False)])
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(text.glob_pattern(glob), path)) == fits


def test_widths(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    s = F.lit
    assert [value(widths.width_of_range(s(t))) for t in ("", "3", "[7:0]", "0:7", "W:0")] == [1, 4, 8, 8, None]
    assert [value(widths.width_of_literal(s(t))) for t in ("8'hFF", "12 ' d1", "'1", "0", "5", "1_6", "x")] == [8, 12, 0, 0, 3, 5, None]
    null = F.lit(None).cast("long")
    assert value(widths.width_of_binary(s("=="), null, null)) == 1 and value(widths.width_of_binary(s("<<"), s(4), null)) == 4
    assert value(widths.width_of_binary(s("+"), s(4), null)) is None and value(widths.width_of_binary(s("+"), s(4), s(6))) == 6
    assert value(widths.width_of_concat(F.array(s(1), s(2)))) == 3 and value(widths.width_of_concat(F.array(s(1), null))) is None
    assert value(widths.width_of_choice(s(2), null)) is None
    assert value(widths.root_signal(s("{ abc[3], d}"))) == "abc" and value(widths.is_parameterized(s("W-1:0")))


def test_graph(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6), (5, 6)], "src int, dst int")
    edges = graph.unit_graph([("unit", a), ("include", a.where("src = 5"))])
    assert edges.count() == 5
    want = {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} | {(5, 6)}
    assert set(rows(graph.closure(edges))) == want
    reached = graph.reachable(edges, spark.createDataFrame([(1,), (6,)], "root int"))
    assert set(rows(reached)) == {(1, 1), (1, 2), (1, 3), (6, 6)}
    assert rows(graph.dependents(reached, spark.createDataFrame([(3,)], "node int"))) == [(3, 1)]
    assert (5, 2, 0) in rows(graph.degrees(edges))


def test_layout(spark):
    found = spark.createDataFrame([("f", 1, "a"), ("f", 2, "bbb"), ("f", 9, "cc")], "path string, at int, name string")
    grouped = layout.islands(found, ["path"], "at", 3)
    assert rows(grouped, "at", "island") == [(1, 0), (2, 0), (9, 1)]
    assert rows(layout.column_widths(grouped, ["island"], ["name"])) == [(0, 3), (1, 2)]
    assert rows(layout.aligned(grouped.withColumn("k", F.col("at").cast("string")), ["island"], ["name", "k"]), "aligned") == [("a   1",), ("bbb 2",), ("cc 9",)]
    code = lines.lines(spark.createDataFrame([("f", "begin\nx\nif begin\ny\nend\nend\n  ")], "p string, t string"), "p", "t")
    depth = layout.depth_of_lines(code, "begin", "end")
    assert [r.depth for r in depth.orderBy("line_no").collect()] == [0, 1, 1, 2, 1, 0, 0]
    assert [r.indented for r in layout.indented(depth, width=2).orderBy("line_no").collect()] == ["begin", "  x", "  if begin", "    y", "  end", "end", ""]
    breaks = spark.createDataFrame([(1, 5, 2), (1, 7, 2), (1, 9, 3)], "line int, at int, cost int")
    assert rows(layout.best_break(breaks, ["line"], F.col("cost"))) == [(1, 7)]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "path string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("n", None)], "path string, text string")
    assert rows(changes.changed_files(old, new)) == [("b", "edited"), ("c", "removed"), ("d", "added")]
    cut = lambda *texts: lines.lines(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "p string, t string"), "p", "t")
    a, b = cut("1\n2\n3\n4", "1\n2", "1\n2\n2", "x"), cut("1\n9\n8\n7\n4", "1\n2", "1\n2\n2\n2", "x\ny")
    assert rows(changes.damaged_range(a, b)) == [("f0", 1, 3, 4), ("f2", 3, 3, 4), ("f3", 1, 1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "a.v").write_text("x\ny\n")
    (tmp_path / "in" / "d" / "b.v").write_text("ü")
    (tmp_path / "in" / "c.txt").write_text("no")
    got = tables.read_sources(spark, str(tmp_path / "in"), suffixes=[".v"])
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in got.collect()) == [("a.v", "x\ny\n"), ("b.v", "ü")]
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n[a.c]\nd = 'x'\n")
    config = tables.config_rows(spark, tables.read_config(str(tmp_path / "c.toml")), "c.toml")
    assert rows(config, "key", "value") == [("a.b", "1"), ("a.c.d", "x")]
    tables.write_json(config, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert "<td>a.b</td>" in tables.summary_html(config.select("key"), "t")


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    snap = lambda *x: spark.createDataFrame(list(x), "path string, text string, t string").selectExpr("path", "text", "timestamp(t) AS ts").write.mode("append").parquet(folder)
    snap(("a", "x ", "2024-01-01 00:00:00"), ("a", "x ", "2024-01-01 00:01:00"))
    stream = streams.arriving(spark, folder)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streams.run_available(streams.style_stream(stream), out, check).awaitTermination()
    snap(("b", "\ty", "2024-01-01 00:05:00"))
    streams.run_available(streams.style_stream(streams.arriving(spark, folder)), out, check).awaitTermination()
    assert rows(spark.read.parquet(out), "path", "code") == [("a", "ST001"), ("a", "ST001"), ("b", "ST002")]
    streams.run_available(streams.distinct_snapshots(stream).select("path", "digest"), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
