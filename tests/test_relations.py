"""Conditional regions, line maps, ports, constants and settings on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import constants, widths
from sievework.operators import conditions, graph, layout, linemap, lines, ports, settings


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def test_nested_conditions(spark):
    marks = [("p", 0, "if", "A"), ("p", 2, "if", "B"), ("p", 4, "else", None), ("p", 6, "endif", None), ("p", 8, "else", None), ("p", 10, "endif", None), ("p", 12, "endif", None), ("p", 14, "else", None), ("p", 16, "if", "C")]
    found = conditions.branches(spark.createDataFrame(marks, "path string, line int, op string, name string"))
    assert rows(found, "line", "level", "block", "name", "branch", "end") == sorted([(0, 1, 1, "A", 0, 8), (2, 2, 1, "B", 0, 4), (4, 2, 1, "B", 1, 6), (8, 1, 1, "A", 1, 10), (16, 1, 2, "C", 0, None)], key=str)
    assert rows(conditions.unclosed(found)) == [("p", 16, "C")]
    text = spark.createDataFrame([("p", i) for i in range(1, 19, 2)] + [("q", 0)], "path string, line_no int")
    active = lambda *names: [r[1] for r in rows(conditions.active_lines(text, conditions.untaken(found, F.col("name").isin(*names)), ["path"]).where("path = 'p'"), "path", "line_no")]
    assert set(active("A", "B", "C")) == {1, 3, 7, 11, 13, 15, 17} and set(active("A")) == {1, 5, 7, 11, 13, 15} and set(active("C")) == {9, 11, 13, 15, 17}
    configs = conditions.configurations(found, 100)
    assert configs.select("config").distinct().count() == 8 and configs.count() == 24
    assert conditions.configurations(found, 3).select("config").distinct().count() == 3
    counts = {r.line_no: r["count"] for r in conditions.in_configurations(text, found, configs).where("path = 'p'").groupBy("line_no").count().collect()}
    assert counts == {1: 4, 3: 2, 5: 2, 7: 4, 9: 4, 11: 8, 13: 8, 15: 8, 17: 4}
    assert rows(conditions.in_configurations(text, found, configs).where("path = 'q'"), "line_no", "config") == [(0, 0)]
    flags = spark.createDataFrame([("p", i, i in (0, 1, 4, 5, 6, 9)) for i in range(10)], "path string, line_no int, flag boolean")
    assert rows(conditions.regions(flags, ["path"]), "first", "end") == [(0, 2), (4, 7), (9, 10)]


def test_annotation_is_idempotent(spark):
    found = conditions.branches(spark.createDataFrame([("p", 0, "if", "A"), ("p", 1, "else", None), ("p", 2, "endif", None)], "path string, line int, op string, name string"))
    ends = spark.createDataFrame([("p", 2, "A")], "path string, line int, name string")
    text = spark.createDataFrame([("p", 0, "if A"), ("p", 1, "else  "), ("p", 2, "endif")], "path string, line_no int, raw string")
    once = conditions.annotated(found, ends, text)
    assert [r[1] for r in rows(once, "line_no", "annotated")] == ["if A", "else // A", "endif // A"]
    again = conditions.annotated(found, ends, once.select("path", "line_no", F.col("annotated").alias("raw")))
    assert rows(again, "line_no", "annotated") == rows(once, "line_no", "annotated")


def test_line_maps_and_edits(spark):
    found = spark.createDataFrame([("p", 3), ("p", 4), ("p", 3)], "path string, line int")
    mapped = linemap.source_lines(found, spark.createDataFrame([("p", 3, 8)], "path string, out_line int, src_line int"))
    assert rows(mapped, "line", "source_line") == [(3, 7), (3, 7), (4, 4)]
    regions = spark.createDataFrame([("p", "M", 3, 4, 2), ("p", "N", 0, 9, 5), ("q", "O", 0, 9, 1)], "path string, macro string, first int, end int, ord int")
    assert rows(linemap.macro_of_line(found, regions), "line", "macro") == [(3, "M"), (3, "M"), (4, "N")]
    texts = spark.createDataFrame([("p", "abcdef"), ("q", "xyz"), ("r", "äöü")], "path string, text string")
    edits = spark.createDataFrame([("p", 4, 6, ""), ("p", 0, 0, "<"), ("p", 1, 3, "BC!"), ("r", 1, 2, "oe")], "path string, first int, end int, new string")
    assert rows(linemap.apply_edits(texts, edits)) == [("p", "<aBC!d"), ("q", "xyz"), ("r", "äoeü")]


def test_constants(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda x: F.lit(x).cast("long")
    for text, want in {"0x1F": 31, "017": 15, "0": 0, "42ul": 42, "0xG": None, "08": None, "9223372036854775808": None, "": None}.items():
        assert value(constants.integer(F.lit(text))) == want, text
    for text, want in {"'a'": 97, r"'\n'": 10, r"'\x41'": 65, r"'\101'": 65, "'ab'": 97 * 256 + 98, r"'\xff'": -1, "''": None, "x": None, r"'\\'": 92}.items():
        assert value(constants.character(F.lit(text))) == want, text
    big, least = (1 << 63) - 1, -(1 << 63)
    for op, a, b, want in [("+", big, 1, None), ("-", least, 1, None), ("*", big, 2, None), ("/", -7, 2, -3), ("%", -7, 2, -1), ("/", 1, 0, None), ("%", 1, 0, None), ("/", least, -1, None), ("<", 1, 2, 1), ("==", 1, 2, 0), ("^", 6, 3, 5), ("&", 6, 3, 2), ("|", 6, 3, 7)]:
        assert value(constants.binary(op, lit(a), lit(b))) == want, (op, a, b)
    assert value(constants.unary("-", lit(least))) is None and value(constants.unary("~", lit(0))) == -1 and value(constants.unary("!", lit(0))) == 1
    for a, n, left, want in [(1, 62, True, 1 << 62), (1, 63, True, None), (5, -1, True, 2), (-1, 200, False, -1), (5, 1, False, 2), (5, -1, False, 10), (0, 500, True, 0), (3, 0, True, 3)]:
        assert value(constants.shift(lit(a), lit(n), left)) == want, (a, n, left)
    for text, want in {"4'b1010": (10, 4), "8'hFf": (255, 8), "'d9": (9, None), "12": (12, None), "4'b1x": (None, 4), "N": (None, None), "6'o17": (15, 6)}.items():
        assert tuple(value(constants.sized_constant(F.lit(text)))) == want, text
    assert value(constants.has_edge(F.lit("posedge clk"))) and not value(constants.has_edge(F.lit("knowledge"))) and not value(constants.has_edge(F.lit(None).cast("string")))
    assert value(widths.width_of_binary(F.lit("??"), lit(4), lit(6))) is None
    assert [value(widths.width_of_select(F.lit(x))) for x in ("[3]", "[7:4]", "[i +: 8]", "[i-:2]", "[a:b]")] == [1, 4, 8, 2, None]


def test_drivers_through_instances(spark):
    """A cycle, a black box, a port without drivers and two levels."""
    own = spark.createDataFrame([("leaf", "y", "leaf:assign#1"), ("top", "z", "top:assign#1")], "unit string, signal string, ref string")
    links = spark.createDataFrame([("top", "x", "i1", "mid", "y"), ("mid", "y", "i2", "leaf", "y"), ("top", "w", "i3", "gone", "q"), ("a", "p", "i4", "b", "p"), ("b", "p", "i5", "a", "p")], "unit string, signal string, inst string, target string, port string")
    declared = spark.createDataFrame([("top", "x"), ("top", "z"), ("top", "w"), ("top", "none"), ("mid", "y"), ("leaf", "y"), ("a", "p"), ("b", "p")], "unit string, port string")
    assert rows(ports.port_drivers(own, links, declared)) == sorted([("top", "x", "leaf:assign#1", 2), ("top", "z", "top:assign#1", 0), ("top", "w", "inst:i3", 0), ("mid", "y", "leaf:assign#1", 1), ("leaf", "y", "leaf:assign#1", 0)], key=str)


def test_settings_layers(spark):
    data = [("l", 0, "a.b", "1"), ("l", 1, "a.b", "2"), ("l", 0, "a.c", "3"), ("l", 0, "d", "4"), ("l", 1, "d.e", "5"), ("l", 0, "f.g", "6"), ("l", 1, "f", "7"), ("m", 0, "a.b", "8")]
    got = settings.merged(spark.createDataFrame(data, "lang string, layer int, path string, value string"), ["lang"])
    assert rows(got, "lang", "path", "value") == sorted([("l", "a.b", "2"), ("l", "a.c", "3"), ("l", "d.e", "5"), ("l", "f", "7"), ("m", "a.b", "8")], key=str)
    entries = [("l", 0, 0, "x", "1"), ("l", 0, 1, "y", "2"), ("l", 1, 0, "y", "3"), ("l", 1, 1, "z", "4")]
    by_name = settings.merged_by_name(spark.createDataFrame(entries, "lang string, layer int, ord int, name string, value string"), ["lang"])
    assert rows(by_name, "ord", "name", "value") == [(0, "x", "1"), (1, "y", "3"), (2, "z", "4")]


def test_breaks_and_closure(spark):
    text = spark.createDataFrame([("p", 0, "aaa bbb cccc dd"), ("p", 1, "nospaces"), ("p", 2, "ends "), ("p", 3, "a b")], "path string, line_no int, raw string")
    assert rows(layout.break_points(text, 8), "line_no", "break_at") == [(0, 8), (3, 2)]
    marked = text.withColumn("raw", F.concat(F.lit("//"), "raw"))
    assert rows(layout.wrapped(marked, 11), "line_no", "part_no", "part")[:2] == [(0, 0, "// aaa bbb"), (0, 1, "// cccc dd")]
    assert rows(lines.split_after(text.where("line_no = 0"), "b", " "), "part_no", "part") == [(0, "aaa bbb"), (1, "cccc dd")]
    edges = [(i, i + 1) for i in range(20)] + [(20, 5)]
    want = set()
    for a in range(21):
        at, b = a, None
        for _ in range(60):
            b = dict(edges)[at]
            want.add((a, b))
            at = b
    assert set(rows(graph.closure(spark.createDataFrame(edges, "src int, dst int")))) == want
