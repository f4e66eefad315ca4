"""Brackets, trees, intervals, scanned text, spliced files, forests and paths against plain versions."""

from __future__ import annotations

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions.paths import normal_path
from sievework.operators import directives, graph, includes, intervals, layout, linemap, pairs, scan, symbols, trees


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_pairs_against_a_stack(spark, chunk):
    rng = random.Random(1)
    marks = [(p, line, o, rng.choice("([{)]}")) for p in "abc" for line in range(12) for o in range(rng.randrange(4))]
    marks += [("deep", i, 0, "(" if i < 200 else ")") for i in range(399)]
    df = spark.createDataFrame([(p, line, o, k, k in "([{") for p, line, o, k in marks], "path string, line_no int, ord int, kind string, opens boolean").repartition(3)
    want, findings, stacks = [], [], {}
    mate = {")": "(", "]": "[", "}": "{"}
    for p, line, o, k in sorted(marks):
        stack = stacks.setdefault(p, [])
        if k in "([{":
            stack.append((line, o, k))
        elif stack:
            a = stack.pop()
            want.append((p, *a, line, o, k))
            if mate[k] != a[2]:
                findings.append((p, line, o, "mismatched", k, 1))
        else:
            findings.append((p, line, o, "unmatched", k, 1))
    for p, stack in stacks.items():
        want += [(p, *a, None, None, None) for a in stack]
        if stack:
            findings.append((p, stack[0][0], stack[0][1], "unclosed", stack[0][2], len(stack)))
    found = pairs.matched(df, chunk)
    got = found.where("opens").select("path", "at.line_no", "at.ord", "kind", "close_at.line_no", "close_at.ord", "close_kind")
    assert rows_of(got) == sorted(want, key=str)
    assert rows_of(pairs.boundary_findings(found, mate)) == sorted(findings, key=str)


def test_value_of_the_last_kept_row(spark):
    rng = random.Random(2)
    marks = [("p", line, o, rng.random() < 0.2, f"{line}.{o}") for line in range(30) for o in range(3)]
    df = spark.createDataFrame(marks, "path string, line_no int, ord int, kept boolean, v string")
    last, want = None, []
    for _, line, o, kept, v in marks:
        want.append((line, o, last))
        last = v if kept else last
    assert rows_of(pairs.after(df, F.col("kept"), "prev", F.col("v"), chunk=4).select("line_no", "ord", "prev")) == sorted(want, key=str)


def test_blocks_cover_an_interval_once(spark):
    spans = [(0, 0), (0, 1), (3, 3), (5, 17), (1, 1024), (7, 8), (1000, 1001), (2**31 - 3, 2**31 + 40), (9, None)]
    df = spark.createDataFrame(spans, "first long, end long")
    for first, end, found in df.select("first", "end", intervals.blocks(F.col("first"), F.col("end")).alias("b")).collect():
        parts = sorted((b.block << b.level, (b.block + 1) << b.level) for b in found or [])
        stop = intervals.NO_END if end is None else end
        assert len(parts) <= 82 and (parts[0][0], parts[-1][1]) == (first, stop) if first < stop else not parts
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_intervals_against_all_pairs(spark):
    rng = random.Random(3)
    regions = [(rng.choice("ab"), n, f := rng.randrange(300), rng.choice([None, f, f + rng.randrange(1, 90)]) if n % 9 == 0 else f + rng.randrange(0, 60)) for n in range(80)]
    points = [(rng.choice("abc"), rng.randrange(400), i) for i in range(200)] + [("a", None, 999)]
    r = spark.createDataFrame(regions, "path string, node int, first int, end int")
    p = spark.createDataFrame(points, "path string, line int, id int")
    holds = lambda x, y: y[0] == x[0] and y[1] is not None and x[2] <= y[1] and (x[3] is None or y[1] < x[3])
    assert rows_of(intervals.holding(p, r, ["path"], "line").select("id", "node")) == sorted([(y[2], x[1]) for x in regions for y in points if holds(x, y)], key=str)
    assert rows_of(intervals.outside(p, r, ["path"], "line").select("id")) == sorted([(y[2],) for y in points if not any(holds(x, y) for x in regions)], key=str)
    closed = [x for x in regions if x[3] is not None]
    best = [(y[2], min(((x[3] - x[2], -x[2], x[1]) for x in closed if holds(x, y)), default=(None,) * 3)[2]) for y in points]
    assert rows_of(linemap.narrowest_region(p, r.where("end is not null")).select("id", "region")) == sorted(best, key=str)
    assert rows_of(intervals.outside(p, r.limit(0), ["path"], "line").select("id")) == sorted([(y[2],) for y in points], key=str)


def test_many_regions_and_lines_of_one_path_stay_linear(spark):
    """100,000 regions and lines of one path: the rows between the joins are a few dozen a row, not their product."""
    n = F.col("id")
    r = spark.range(100_000).select(F.lit("p").alias("path"), n.alias("ord"), (n % 99_991).alias("first"), (n % 99_991 + n % 997).alias("end"), n.cast("string").alias("macro"))
    p = spark.range(100_000).select(F.lit("p").alias("path"), n.alias("line"))
    assert intervals.cut(r.select("path", "first", "end")).count() < 100_000 * 20
    assert linemap.macro_of_line(p, r).where("macro is not null").count() > 99_000
    assert directives.unsuppressed(p, r.select("path", F.col("first").alias("start"), "end")).count() < 1000


def test_tree_of_spans_and_folds(spark):
    """Nested spans become a tree; folds over narrow ranges equal recursion."""
    rng = random.Random(4)
    spans, nodes = [], []

    def grow(tree, at, depth, parent, ord_):
        me, first = len([x for x in nodes if x[0] == tree]), at
        nodes.append([tree, me, 1, parent, ord_])
        row, at, k = nodes[-1], at + 1, 0
        while depth < 6 and rng.random() < 0.6:
            at = grow(tree, at, depth + 1, me, k)
            k += 1
        row[2] = len([x for x in nodes if x[0] == tree]) - me
        spans.append((tree, first, at))
        return at + 1

    for tree in range(12):
        end = grow(tree, 0, 0, None, 0)
        if tree % 3 == 0:
            grow(tree, end, 0, None, 1)
    df = spark.createDataFrame(spans, "tree long, first long, end long").repartition(3)
    tree = trees.tree_of_spans(df)
    assert rows_of(tree.select("tree", "node", "size", "parent", "ord")) == sorted(map(tuple, nodes), key=str)

    kids = {}
    for t, node, _, parent, ord_ in nodes:
        kids.setdefault((t, parent), []).append((ord_, node))
    kind = {(t, n): "assign" if (t, n) not in kids else rng.choice(["sequence", "choice", "partial", "loop", "run_loop"]) for t, n, *_ in nodes}
    own = {k: rng.choice(["x", "y", "z", None]) for k, v in kind.items() if v == "assign"}

    def must(t, n):
        k, parts = kind[t, n], [must(t, c) for _, c in sorted(kids.get((t, n), []))]
        if k == "assign":
            return {own[t, n]} - {None}
        if k == "partial" or not parts:
            return set()
        return set.intersection(*parts) if k == "choice" else parts[0] if k == "loop" else set().union(*parts[1:]) if k == "run_loop" else set().union(*parts)

    table = spark.createDataFrame([(*map(int, x[:3]), x[3], x[4], kind[x[0], x[1]], own.get((x[0], x[1]))) for x in nodes], "tree long, node long, size long, parent long, ord int, kind string, own string")
    whole = trees.with_parent_kinds(table)
    for width in (1, 3, 4096):
        got = trees.folded(whole, trees.MUST_ASSIGN, width=width, step=4)
        assert {(r.tree, r.node): set(r.value) for r in got.collect()} == {(t, n): must(t, n) for t, n, *_ in nodes}
    lost = trees.not_always_assigned(whole, got)
    for t in range(12):
        all_ = {own[k] for k in own if k[0] == t} - {None}
        sure = set().union(*(must(t, n) for _, n in kids[t, None]))
        assert {r.name for r in lost.where(f"tree = {t}").collect()} == all_ - sure


def test_fold_of_a_deep_tree(spark):
    """A thousand levels: sums of widths, and constants with wrapped, unknown and dividing operators."""
    depth = 1000
    rows = [(1, 2 * i, 2 * (depth - i) + 1, 2 * i - 2 if i else None, 1 if i else 0, "concat", None) for i in range(depth)]
    rows += [(1, 2 * i + 1, 1, 2 * i, 0, "leaf", 2) for i in range(depth)] + [(1, 2 * depth, 1, 2 * depth - 2, 1, "leaf", 5)]
    df = trees.with_parent_kinds(spark.createDataFrame(rows, "tree long, node long, size long, parent long, ord int, kind string, own long"))
    got = trees.folded(df, trees.WIDTHS, width=50, step=8)
    assert got.where("parent is null").first().value == 2 * depth + 5 and got.count() == 2 * depth + 1
    tree = lambda t, op, *own: [(t, 0, 1 + len(own), None, 0, op, None), *((t, i + 1, 1, 0, i, "leaf", v) for i, v in enumerate(own))]
    cases = [("+", 2, 3), ("-", 2, 3), ("/", -7, 2), ("%", -7, 2), ("/", 1, 0), ("*", 2**62, 4), ("<", 1, 2), ("?", 0, 8, 9), ("?", None, 8, 9), ("~", 0), ("!", 4), ("+", None, 1)]
    df = trees.with_parent_kinds(spark.createDataFrame([r for t, c in enumerate(cases) for r in tree(t, *c)], "tree long, node long, size long, parent long, ord int, kind string, own long"))
    values = {r.tree: r.value for r in trees.folded(df, trees.CONSTANTS).where("parent is null").collect()}
    assert [values[t] for t in range(len(cases))] == [5, -1, -3, -1, None, None, 1, 9, None, -1, 0, None]
    widths = trees.folded(trees.with_parent_kinds(spark.createDataFrame(tree(1, "?", 9, 3, 4) + tree(2, "<<", 5, 30) + tree(3, "==", 5, 30) + tree(4, "+", 5, None), df.drop("parent_kind").select("tree", "node", "size", "parent", "ord", "kind", "own").schema)), trees.WIDTHS)
    assert {r.tree: r.value for r in widths.where("parent is null").collect()} == {1: 4, 2: 5, 3: 1, 4: None}
    runs = spark.createDataFrame([(0, "<", 1), (0, "<", 0), (3, "!=", 3), (None, "<", 1), (0, "??", 1)], "a int, op string, b int").select(trees.loop_runs(F.col("a"), F.col("op"), F.col("b")).alias("x"))
    assert [r.x for r in runs.collect()] == [True, False, False, None, None]


def marks_by_character(text, s):
    """(line, kind, content, closed) of comments, one character after the other."""
    out, line, i, state, begin = [], 0, 0, None, 0
    while i < len(text):
        if state is None:
            hit = next((d for d in s.delimiters() if d != (s.block or ("", ""))[1] and text.startswith(d, i)), None)
            if hit:
                state, i, begin = hit, i + len(hit), i + len(hit)
                continue
        else:
            close = "\n" if state == s.line else s.block[1] if s.block and state == s.block[0] else state
            over = state in s.long_quotes or (s.block and state == s.block[0])
            if text[i] == "\\" and state in (*s.quotes, *s.long_quotes) and i + 1 < len(text) and text[i + 1] != "\n":
                i += 2
                continue
            if text.startswith(close, i) and close != "\n":
                out.append((line, state, text[begin:i], True))
                state, i = None, i + len(close)
                continue
            if text[i] == "\n" and not over:
                out.append((line, state, text[begin:i], state == s.line))
                state = None
        if text[i] == "\n":
            if state is not None:
                out.append((line, state, text[begin:i], False))
                begin = i + 1
            line += 1
        i += 1
    return out


def plain_suppressions(text, s):
    import re

    by_line = {}
    for line, state, content, closed in marks_by_character(text + "\n", s):
        by_line.setdefault(line, []).append((scan.BLOCK if s.block and state == s.block[0] else scan.LINE if state == s.line else scan.STRING, content, closed))
    silent, pending, n = {}, None, text.count("\n") + 1
    for line in range(n):
        m = scan.marks_of(by_line.get(line, []), s)
        if pending is not None and m["on"]:
            for x in range(pending[0], line):
                silent.setdefault(x, []).append((pending[1], False))
            pending = None
        elif pending is None and m["off"]:
            pending = line, m["off_codes"]
        elif m["one"]:
            silent.setdefault(line, []).append((m["one_codes"], True))
    for x in range(pending[0], n) if pending else ():
        silent.setdefault(x, []).append((pending[1], False))
    out = set()
    for x, found in silent.items():
        if len(found) == 2:
            found = [(c, single) for c, single in found if not (single and c is None)]
        codes = None if any(c is None for c, _ in found) else frozenset(y for c, _ in found for y in c)
        out.add((x, codes))
    assert re.escape(s.word)
    return out


@pytest.mark.parametrize("syntax", [scan.Syntax(), scan.Syntax(line="#", block=None, quotes=("'", '"'), long_quotes=('"""',)), scan.Syntax(line="--", block=("(*", "*)"), word="lint")])
def test_scan_against_characters(spark, syntax):
    rng = random.Random(5)
    block = syntax.block or ("#", "")
    w, one = syntax.word, syntax.line
    bits = ["x", " ", "\\", '"', "'", '"""', one, *block, f"{block[0]} {w} off{block[1]}", f"{block[0]} {w} off A B {block[1]}", f"{block[0]}{w} on {block[1]}", f"{one} {w}: disable-line", f"{one} {w}: disable-line A C", "*/", "/"]
    texts = ["\n".join("".join(rng.choice(bits) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i, n, raw) for i, t in enumerate(texts) for n, raw in enumerate(t.split("\n"))]
    marks = scan.scanned(spark.createDataFrame(rows, "path int, line_no int, raw string").repartition(3), syntax)
    found = scan.suppressions(marks).collect()
    for i, text in enumerate(texts):
        got, n = {}, text.count("\n") + 1
        for r in found:
            if r.path == i:
                for x in range(r.first, n if r.end is None else r.end):
                    got.setdefault(x, []).append(r.codes)
        have = {(x, None if None in c else frozenset(y for z in c for y in z)) for x, c in got.items()}
        assert have == plain_suppressions(text, syntax), text


def test_running_state_in_chunks(spark):
    rng = random.Random(6)
    tables = [[rng.randrange(3) for _ in range(3)] if rng.random() < 0.7 else [0, 1, 2] for _ in range(100)]
    state, want = 1, []
    for i, t in enumerate(tables):
        want.append((i, state))
        state = t[state]
    df = spark.createDataFrame([("p", i, t, "more") for i, t in enumerate(tables)], "path string, line_no int, t array<int>, `a.b` string").repartition(3)
    for chunk in (1, 7, 512):
        assert rows_of(scan.running(df, "t", 3, "state", begin=1, chunk=chunk).select("line_no", "state")) == sorted(want, key=str)


def test_splice_against_recursion(spark):
    rng = random.Random(7)
    files = {f: [f"{f}{i}" for i in range(rng.randrange(1, 6))] for f in "abcdefg"}
    inc = {(f, i): rng.choice([None, *"abcdefg"]) for f, body in files.items() for i in range(len(body)) if rng.random() < 0.4}
    inc[("a", 0)] = "a"
    problems, out = [], []

    def expand(root, f, stack, key):
        for i, raw in enumerate(files[f]):
            if (f, i) not in inc:
                out.append((root, sum(r[0] == root for r in out), f, i, len(stack), raw))
                continue
            target = inc[f, i]
            bad = "missing" if target is None else "cycle" if target in stack else "depth" if len(stack) >= 4 else None
            if bad:
                problems.append((root, f, i, target, bad))
            else:
                expand(root, target, [*stack, target], [*key, i])

    for root in "abcdefg":
        expand(root, root, [root], [])
    lines = spark.createDataFrame([(f, i, raw) for f, body in files.items() for i, raw in enumerate(body)], "file string, line_no int, raw string")
    named = spark.createDataFrame([(f, i, t) for (f, i), t in inc.items()], "file string, line_no int, target string")
    places, found = includes.expansions(named, spark.createDataFrame([(f,) for f in files], "root string"), 4)
    assert rows_of(includes.spliced(lines, named, places)) == sorted(out, key=str)
    assert rows_of(found.select("root", "file", "line_no", "target", "problem")) == sorted(problems, key=str)


def test_forest_against_recursion(spark):
    rng = random.Random(8)
    edges, roots, want = [], [], []
    for forest in range(25):
        n = rng.randrange(1, 9)
        each = {}
        for src in range(n):
            for dst in rng.sample(range(n), rng.randrange(min(n, 4) + 1)):
                if src != dst:
                    each.setdefault(src, []).append((rng.choice(["use", "inc"]), dst))
        edges += [(forest, kind, src, dst, i) for src, found in each.items() for i, (kind, dst) in enumerate(found)]
        tops = rng.sample(range(n), rng.randrange(1, min(n, 3) + 1))
        roots += [(forest, r, i) for i, r in enumerate(tops)]
        seen = set()
        for i, r in enumerate(tops):
            shown = [f"● n{r}  [root]"]
            seen.add(r)

            def children(node, bars, each=each, seen=seen, shown=shown):
                for k, (kind, dst) in enumerate(each.get(node, [])):
                    last = k == len(each[node]) - 1
                    text = f"{bars}{'└─ ' if last else '├─ '}[{kind}] n{dst}"
                    shown.append(text + "  (seen)" * (dst in seen))
                    if dst not in seen:
                        seen.add(dst)
                        children(dst, bars + ("    " if last else "│   "))

            children(r, "")
            want += [(forest, i, k, text) for k, text in enumerate(shown)]
    captions = spark.createDataFrame([(f, n, f"n{n}") for f in range(25) for n in range(9)], "forest int, node int, caption string")
    got = graph.rendered_forest(spark.createDataFrame(edges, "forest int, kind string, src int, dst int, ord int"), spark.createDataFrame(roots, "forest int, node int, ord int"), captions)
    assert rows_of(got) == sorted(want, key=str)


def test_reachable_over_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0), (7, 3)], "src int, dst int")
    got = graph.reachable(edges, spark.createDataFrame([(0,), (39,), (99,)], "root int"), merged_after=4)
    assert rows_of(got) == sorted([(r, n) for r in (0, 39) for n in range(41)] + [(99, 99)], key=str)


def test_visible_names(spark):
    rng = random.Random(9)
    scopes = [("p", 0, 0, None), ("p", 1, 10, 50), ("p", 2, 20, 30), ("p", 3, 35, 40), ("p", 4, 60, 70), ("q", 5, 0, 100)]
    declared = [(rng.choice("pq"), rng.choice("xy"), rng.randrange(0, 75), s, i) for i in range(60) for s in [rng.randrange(6)]]
    declared = [d for d in declared if any(s[0] == d[0] and s[1] == d[3] and s[2] <= d[2] and (s[3] is None or d[2] < s[3]) for s in scopes)]
    uses = [(rng.choice("pq"), rng.choice("xyz"), rng.randrange(0, 90), i) for i in range(120)]
    want = []
    for p, name, line, i in uses:
        held = [(s[2], -(s[3] or 10**9), d[2], d[4], d[3]) for d in declared for s in scopes if d[:2] == (p, name) and d[2] <= line and s[:2] == (p, d[3]) and s[2] <= line and (s[3] is None or line < s[3])]
        want.append((i, *(max(held)[3:] if held else (None, None))))
    got = symbols.visible(
        spark.createDataFrame(uses, "path string, name string, line int, id int"), spark.createDataFrame(declared, "path string, name string, line int, scope int, symbol int"),
        spark.createDataFrame(scopes, "path string, scope int, first int, end int"))
    assert rows_of(got.select("id", "symbol", "scope")) == sorted(want, key=str)


def test_normal_paths(spark):
    rng = random.Random(10)
    texts = ["", ".", "..", "/", "//", "///", "//a/..", "/..", "a/..", "a/../..", "./a//b/", *("".join(rng.choice(["a", "b", "/", "/", ".", "..", "/../", "é"]) for _ in range(rng.randrange(12))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = df.select("p", normal_path(F.col("p")).alias("a"), normal_path(F.col("p"), F.lit("/base/dir")).alias("b")).collect()
    for r in got:
        assert r.a == posixpath.normpath(r.p) and r.b == posixpath.normpath(posixpath.join("/base/dir", r.p)), r.p
    assert spark.sql("select 'C\\\\\\\\Dir\\\\\\\\..\\\\\\\\X' as p").select(normal_path(F.col("p"), fold_case=True)).first()[0] == "c/x"
    same = graph.normal_edges(spark.createDataFrame([("i", "a/./b", "c"), ("i", "a/b", "./c"), ("i", "x/../y", "y")], "kind string, src string, dst string"))
    assert rows_of(same) == [("i", "a/b", "c")]


def test_wrapped_comments_fill_greedily(spark):
    words = " ".join(["w" * 30] * 6)
    rows = [("p", 0, "  // " + words), ("p", 1, "//" + "x" * 120), ("p", 2, "code // " + words), ("p", 3, "// short"), ("p", 4, "//" + " " * 100), ("p", 5, "//a " + "b" * 90 + " c")]
    got = layout.wrapped(spark.createDataFrame(rows, "path string, line_no int, raw string"), 80).collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r.line_no, r.part_no)):
        parts.setdefault(r.line_no, []).append(r.part)
    w = "w" * 30
    assert parts == {0: [f"  // {w} {w}"] * 3, 1: ["// " + "x" * 120], 2: ["code // " + words], 3: ["// short"], 4: ["//" + " " * 100], 5: ["// a", "// " + "b" * 90, "// c"]}
