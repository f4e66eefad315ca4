"""Queries over brackets, trees, intervals, scanned text, spliced files, forests and paths, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import normal_path
from ..functions.widths import root_signal
from ..operators import directives, graph, includes, layout, lines, linemap, pairs, scan, symbols, trees
from ..sources.tables import read_table, stored
from .queries import _LINES_SQL, _lines, query
from .regions import _FINDINGS_SQL, _findings

_MARK = r"</?[a-z][a-z0-9]*|[\[\](){}]"
#: Elements that have no end.
_VOID = ("meta", "br")
_TAGS = ("html", "head", "title", "style", "script", "body", "nav", "ul", "li", "a", "div", "article", "h1", "p", "b", "footer")
_PAIRS = {")": "(", "]": "[", "}": "{"} | {"/" + t: t for t in _TAGS}

#: A stack, one mark of each page a step.
_STACK_SQL = (
    "t AS (SELECT path, line_no, generate_subscripts(x, 1) - 1 AS ord, unnest(x) AS c FROM (SELECT path, line_no, regexp_extract_all(raw, '" + _MARK.replace("[\\[\\](){}]", "[][(){}]") + "') AS x FROM "
    "(SELECT page_id AS path, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line_no, unnest(string_split(html, chr(10))) AS raw FROM pages))), "
    "k AS (SELECT path, line_no, ord, replace(c, '<', '') AS kind, NOT (c LIKE '</%' OR c IN (')', ']', '}')) AS opens FROM t WHERE c NOT IN ('<meta', '<br')), "
    "q AS (SELECT *, last_value(CASE WHEN opens THEN kind END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no, ord) AS i FROM q WHERE NOT (kind = '{' AND coalesce(prev, '') = 'style')), "
    "st AS (SELECT path, 0::BIGINT AS i, []::BIGINT[] AS stack, NULL::BIGINT AS took, false AS alone FROM m GROUP BY path UNION ALL "
    "SELECT st.path, m.i, CASE WHEN m.opens THEN list_append(st.stack, m.i) ELSE st.stack[1 : len(st.stack) - 1] END, CASE WHEN m.opens THEN NULL ELSE st.stack[len(st.stack)] END, NOT m.opens AND len(st.stack) = 0 "
    "FROM st JOIN m ON m.path = st.path AND m.i = st.i + 1), "
    "pr AS (SELECT o.path, o.line_no, o.ord, o.kind, o.i AS s, c.line_no AS close_line, c.ord AS close_ord, c.kind AS close_kind, c.i AS e FROM m o LEFT JOIN (SELECT st.path, st.took, m.* EXCLUDE (path) FROM st JOIN m USING (path, i) WHERE took IS NOT NULL) c ON c.path = o.path AND c.took = o.i WHERE o.opens)"
)


def _page_marks(spark, sf):
    rows = lines.lines(read_table(spark, sf, "pages"), "page_id", "html")
    found = rows.select("path", "line_no", F.posexplode(F.regexp_extract_all("raw", F.lit(f"({_MARK})"), F.lit(1))).alias("ord", "c")).where(~F.col("c").isin(*("<" + v for v in _VOID)))
    closes = F.startswith("c", F.lit("</")) | F.col("c").isin(")", "]", "}")
    marks = found.select("path", "line_no", "ord", F.replace("c", F.lit("<")).alias("kind"), (~closes).alias("opens"))
    told = pairs.after(marks, F.col("opens"), "prev", F.col("kind"))
    return told.where(~((F.col("kind") == "{") & (F.coalesce("prev", F.lit("")) == "style"))).drop("prev")


@query(f"WITH RECURSIVE {_STACK_SQL} SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(ord AS INTEGER) AS ord, kind, CAST(close_line AS INTEGER) AS close_line, CAST(close_ord AS INTEGER) AS close_ord, close_kind FROM pr")
def bracket_pairs(spark, sf):
    """Openers of several kinds with what closes them."""
    found = pairs.matched(_page_marks(spark, sf)).where("opens")
    return found.select("path", "at.line_no", "at.ord", "kind", F.col("close_at.line_no").alias("close_line"), F.col("close_at.ord").alias("close_ord"), "close_kind")


@query(
    f"WITH RECURSIVE {_STACK_SQL}, x AS (SELECT path, line_no, ord, 'unmatched' AS finding, kind, 1 AS n FROM st JOIN m USING (path, i) WHERE alone UNION ALL "
    "SELECT path, close_line, close_ord, 'mismatched', close_kind, 1 FROM pr WHERE e IS NOT NULL AND kind <> CASE close_kind WHEN ')' THEN '(' WHEN ']' THEN '[' WHEN '}' THEN '{' ELSE substr(close_kind, 2) END UNION ALL "
    "SELECT path, min_by(line_no, s), min_by(ord, s), 'unclosed', min_by(kind, s), count(*) FROM pr WHERE e IS NULL GROUP BY path) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(ord AS INTEGER) AS ord, finding, kind, CAST(n AS BIGINT) AS n FROM x"
)
def boundary_findings(spark, sf):
    return pairs.boundary_findings(pairs.matched(_page_marks(spark, sf)), _PAIRS)


#: Elements of pages as a tree: node numbers, parents and places among siblings.
_TREE_SQL = (
    f"{_STACK_SQL}, sp AS (SELECT path, kind AS tag, s, e, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS node FROM pr WHERE e IS NOT NULL), "
    "up AS (SELECT a.path, a.node, max(b.node) AS parent, count(b.node) AS depth FROM sp a LEFT JOIN sp b ON b.path = a.path AND b.s < a.s AND b.e > a.e GROUP BY ALL), "
    "tr AS (SELECT *, row_number() OVER (PARTITION BY path, parent ORDER BY node) - 1 AS ord FROM sp JOIN up USING (path, node))"
)


def _page_tree(spark, sf):
    marks = _page_marks(spark, sf)
    found = pairs.matched(marks).where("opens and close_at is not null")
    # places as one number: lines and places in a line are both below 2^31
    number = lambda c: F.shiftleft(F.col(f"{c}.line_no").cast("long"), 31) + F.col(f"{c}.ord")
    return trees.tree_of_spans(found.select(F.col("path").alias("tree"), number("at").alias("first"), number("close_at").alias("end"), F.col("kind").alias("tag")))


_BLOCK_SQL = (
    "bl AS (SELECT path, node, parent, ord, depth, CASE WHEN tag IN ('a', 'b', 'title', 'h1') THEN 'assign' WHEN tag = 'ul' THEN 'choice' WHEN tag = 'p' AND node % 3 = 0 THEN 'partial' "
    "WHEN tag = 'article' AND path % 3 = 0 THEN 'loop' WHEN tag = 'article' AND path % 3 = 1 THEN 'run_loop' ELSE 'sequence' END AS kind, "
    "CASE WHEN tag = 'a' THEN 'n' || (path + node // 40) % 3 WHEN tag IN ('b', 'title', 'h1') THEN tag END AS own FROM tr)"
)


def _blocks(spark, sf):
    tag, node, tree = F.col("tag"), F.col("node"), F.col("tree")
    kind = (
        F.when(tag.isin("a", "b", "title", "h1"), "assign").when(tag == "ul", "choice").when((tag == "p") & (node % 3 == 0), "partial")
        .when((tag == "article") & (tree % 3 == 0), "loop").when((tag == "article") & (tree % 3 == 1), "run_loop").otherwise("sequence")
    )
    own = F.when(tag == "a", F.concat(F.lit("n"), ((tree + F.floor(node / 40)) % 3).cast("string"))).when(tag.isin("b", "title", "h1"), tag)
    return trees.with_parent_kinds(_page_tree(spark, sf).withColumns({"kind": kind, "own": own}))


@query(
    f"WITH RECURSIVE {_TREE_SQL}, {_BLOCK_SQL}, names AS (SELECT DISTINCT path, own AS name FROM bl WHERE kind = 'assign'), "
    "fo AS (SELECT path, node, parent, ord, depth, kind, name, kind = 'assign' AND own = name AS sure FROM bl JOIN names USING (path) WHERE depth = (SELECT max(depth) FROM bl) UNION ALL "
    "SELECT b.path, b.node, b.parent, b.ord, b.depth, b.kind, n.name, CASE b.kind WHEN 'assign' THEN b.own = n.name WHEN 'partial' THEN false WHEN 'choice' THEN coalesce(c.every, false) WHEN 'loop' THEN coalesce(c.begin_, false) WHEN 'run_loop' THEN coalesce(c.body, false) ELSE coalesce(c.some, false) END "
    "FROM bl b JOIN names n USING (path) LEFT JOIN (SELECT path, parent, name, bool_and(sure) AS every, bool_or(sure) AS some, bool_or(sure AND ord = 0) AS begin_, bool_or(sure AND ord > 0) AS body FROM fo GROUP BY ALL) c ON c.path = b.path AND c.parent = b.node AND c.name = n.name "
    "WHERE b.depth = (SELECT max(depth) - 1 FROM fo)), "
    "ro AS (SELECT path, name, bool_or(sure) AS sure FROM fo WHERE parent IS NULL GROUP BY ALL) "
    "SELECT path, name, min(node) AS node FROM bl JOIN ro USING (path) WHERE kind = 'assign' AND own = name AND NOT sure GROUP BY path, name"
)
def must_assign(spark, sf):
    """Names that a page's blocks assign on some ways through them, not on all."""
    blocks = stored(_blocks(spark, sf), "blocks")
    found = trees.not_always_assigned(blocks, trees.folded(blocks, trees.MUST_ASSIGN, width=64))
    return found.select(F.col("tree").alias("path"), "name", "node")


@query(
    f"WITH RECURSIVE {_TREE_SQL}, ex AS (SELECT path, node, parent, ord, depth, CASE WHEN tag IN ('a', 'b', 'title', 'h1') THEN 'leaf' WHEN tag = 'nav' THEN 'repeat' WHEN tag = 'article' THEN '+' WHEN tag = 'body' THEN '?' WHEN tag = 'head' THEN '<<' WHEN tag = 'p' THEN '==' ELSE 'concat' END AS kind, "
    "CASE WHEN tag = 'nav' THEN path % 3 WHEN tag IN ('a', 'b', 'title', 'h1') AND (path + node) % 41 > 0 THEN (path + node) % 16 END AS own FROM tr), "
    "fo AS (SELECT path, node, parent, ord, depth, CASE WHEN kind = 'leaf' THEN own WHEN kind = 'concat' THEN 0 WHEN kind = 'repeat' THEN 0 * own WHEN kind = '==' THEN 1 END::BIGINT AS w FROM ex WHERE depth = (SELECT max(depth) FROM ex) UNION ALL "
    "SELECT e.path, e.node, e.parent, e.ord, e.depth, CASE e.kind WHEN 'leaf' THEN e.own WHEN '==' THEN 1 WHEN 'concat' THEN CASE WHEN c.n IS NULL THEN 0 WHEN c.n = c.known THEN c.total END WHEN 'repeat' THEN e.own * CASE WHEN c.n IS NULL THEN 0 WHEN c.n = c.known THEN c.total END "
    "WHEN '<<' THEN c.head WHEN '+' THEN CASE WHEN c.n = c.known THEN c.most END ELSE CASE WHEN c.later = c.later_known THEN c.later_most END END::BIGINT "
    "FROM ex e LEFT JOIN (SELECT path, parent, count(*) AS n, count(w) AS known, sum(w) AS total, max(w) AS most, max(w) FILTER (ord = 0) AS head, count(*) FILTER (ord > 0) AS later, count(w) FILTER (ord > 0) AS later_known, max(w) FILTER (ord > 0) AS later_most FROM fo GROUP BY ALL) c "
    "ON c.path = e.path AND c.parent = e.node WHERE e.depth = (SELECT max(depth) - 1 FROM fo)) "
    "SELECT path, node, w AS width FROM fo"
)
def folded_widths(spark, sf):
    """Widths of expression trees, from their leaves up."""
    tag, node, tree = F.col("tag"), F.col("node"), F.col("tree")
    leaf = tag.isin("a", "b", "title", "h1")
    kind = F.when(leaf, "leaf").when(tag == "nav", "repeat").when(tag == "article", "+").when(tag == "body", "?").when(tag == "head", "<<").when(tag == "p", "==").otherwise("concat")
    own = F.when(tag == "nav", tree % 3).when(leaf & ((tree + node) % 41 > 0), (tree + node) % 16)
    nodes = trees.with_parent_kinds(_page_tree(spark, sf).withColumns({"kind": kind, "own": own}))
    return trees.folded(nodes, trees.WIDTHS, width=64).select(F.col("tree").alias("path"), "node", F.col("value").alias("width"))


@query(
    f"WITH {_FINDINGS_SQL}, g AS (SELECT o_custkey % 100 + 1 AS path, o_orderkey AS node, o_orderkey % 450 AS first, o_orderkey % 450 + (o_custkey % 13) * (o_custkey % 5) AS stop FROM orders), "
    "w AS (SELECT DISTINCT path, line FROM f), b AS (SELECT w.path, w.line, arg_min(node, row(stop - first, -first, node)) AS region FROM w JOIN g ON g.path = w.path AND w.line >= g.first AND w.line < g.stop GROUP BY ALL) "
    "SELECT finding_id, region FROM f LEFT JOIN b USING (path, line)"
)
def narrowest_regions(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    found = read_table(spark, sf, "orders").select((c % 100 + 1).alias("path"), o.alias("node"), (o % 450).alias("first"), (o % 450 + (c % 13) * (c % 5)).alias("end"))
    return linemap.narrowest_region(_findings(spark, sf), found).select("finding_id", "region")


_SILENT = ("/* check off A B */ x", "/* check on */", "y // check: disable-line C", "/* open", "close */ z", '"/* check off */"', "// /* check off */", "/* check off */", "// check: disable-line", '"/*" /* check on */ /* check off D */')
_SCAN_SQL = (
    "sl AS (SELECT path, line_no, regexp_replace(raw, '[\"/*]', '', 'g') || ' ' || CASE (path * 3 + line_no) % 23 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_SILENT)) + " ELSE '' END AS raw FROM (" + _LINES_SQL + ")), "
    "tk AS (SELECT path, line_no, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT path, line_no, list_append(regexp_extract_all(raw, '/\\* check off[ A-Z]*\\*/|/\\* check on \\*/|// check: disable-line[ A-Z]*|/\\*|\\*/|//|\"'), chr(10)) AS x FROM sl)), "
    "sq AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no, i) AS n FROM tk), "
    "md AS (SELECT path, 0::BIGINT AS n, 'code' AS mode, NULL::VARCHAR AS mark FROM sq GROUP BY path UNION ALL SELECT md.path, sq.n, "
    "CASE mode WHEN 'code' THEN CASE WHEN c LIKE '/* check%' THEN 'code' WHEN c = '/*' THEN 'block' WHEN c LIKE '//%' THEN 'line' WHEN c = '\"' THEN 'string' ELSE 'code' END "
    "WHEN 'block' THEN CASE WHEN c LIKE '%*/' THEN 'code' ELSE 'block' END WHEN 'line' THEN CASE WHEN c = chr(10) THEN 'code' ELSE 'line' END ELSE CASE WHEN c IN (chr(10), '\"') THEN 'code' ELSE 'string' END END, "
    "CASE WHEN mode = 'code' AND (c LIKE '/* check%' OR c LIKE '// check:%') THEN c END FROM md JOIN sq ON sq.path = md.path AND sq.n = md.n + 1), "
    "lm AS (SELECT path, line_no, bool_or(mark LIKE '/* check off%') AS off_, bool_or(mark LIKE '/* check on%') AS on_, bool_or(mark LIKE '//%') AS one_, "
    "trim(replace(replace(max(CASE WHEN mark LIKE '/* check off%' THEN mark END), '/* check off', ''), '*/', '')) AS off_codes, trim(replace(max(CASE WHEN mark LIKE '//%' THEN mark END), '// check: disable-line', '')) AS one_codes, "
    "row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM md JOIN sq USING (path, n) WHERE mark IS NOT NULL GROUP BY path, line_no), "
    "pe AS (SELECT path, 0::BIGINT AS n, false AS pending, NULL::BIGINT AS began, NULL::BIGINT AS ended, false AS single, NULL::VARCHAR AS codes FROM lm GROUP BY path UNION ALL "
    "SELECT pe.path, lm.n, CASE WHEN pe.pending THEN NOT on_ ELSE off_ END, CASE WHEN NOT pe.pending AND off_ THEN lm.line_no ELSE pe.began END, CASE WHEN pe.pending AND on_ THEN lm.line_no END, "
    "one_ AND NOT (pe.pending AND on_) AND NOT (NOT pe.pending AND off_) AND NOT (pe.pending AND one_codes = ''), CASE WHEN NOT pe.pending AND off_ THEN off_codes ELSE pe.codes END FROM pe JOIN lm ON lm.path = pe.path AND lm.n = pe.n + 1), "
    "rg AS (SELECT path, began AS first, ended AS stop, codes FROM pe WHERE ended IS NOT NULL UNION ALL SELECT path, arg_max(began, n), NULL, arg_max(codes, n) FROM pe GROUP BY path HAVING arg_max(pending, n) UNION ALL "
    "SELECT path, line_no, line_no + 1, one_codes FROM pe JOIN lm USING (path, n) WHERE single)"
)


def _silent_lines(spark, sf):
    n = (F.col("path") * 3 + F.col("line_no")) % 23
    head = F.lit("")
    for i, t in enumerate(_SILENT):
        head = F.when(n == i, t).otherwise(head)
    return _lines(spark, sf).withColumn("raw", F.concat(F.regexp_replace("raw", '["/*]', ""), F.lit(" "), head))


@query(f"WITH RECURSIVE {_SCAN_SQL} SELECT path, CAST(first AS INTEGER) AS first, CAST(stop AS INTEGER) AS stop, CASE WHEN codes <> '' THEN codes END AS codes FROM rg")
def scanned_suppressions(spark, sf):
    """Where findings are silenced, read from raw text; marks within strings, comments and commented-out text do not count."""
    found = scan.suppressions(scan.scanned(_silent_lines(spark, sf)))
    return found.select("path", "first", F.col("end").alias("stop"), F.array_join("codes", " ").alias("codes"))


@query(
    f"WITH RECURSIVE {_SCAN_SQL}, fi AS (SELECT path, line_no, CASE (path + line_no) % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'E' END AS code FROM sl) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, code FROM fi WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.path = fi.path AND rg.first <= fi.line_no AND (rg.stop IS NULL OR rg.stop > fi.line_no) AND (rg.codes = '' OR list_contains(string_split(rg.codes, ' '), fi.code)))"
)
def findings_not_silenced(spark, sf):
    """A finding on each line, without those that the line's marks silence."""
    rows = _silent_lines(spark, sf)
    n = (F.col("path") + F.col("line_no")) % 5
    found = rows.select("path", F.col("line_no").alias("line"), F.when(n == 0, "A").when(n == 1, "C").when(n == 2, "D").otherwise("E").alias("code"))
    return directives.not_silenced(found, scan.suppressions(scan.scanned(rows))).select("path", F.col("line").alias("line_no"), "code")


_INCLUDES_SQL = (
    "li AS (SELECT path AS file, line_no, raw FROM (" + _LINES_SQL + ")), nd AS (SELECT count(*) AS n FROM documents), "
    "ic AS (SELECT file, line_no, CASE WHEN (file + line_no) % 4 = 0 THEN NULL ELSE t END AS target FROM (SELECT file, line_no, CASE WHEN line_no % 2 = 0 THEN file * 2 + 1 ELSE file // 3 END AS t FROM li WHERE (file * 3 + line_no) % 11 = 0) WHERE t IN (SELECT doc_id FROM documents) OR (file + line_no) % 4 = 0)"
)


def _include_lines(spark, sf):
    rows = _lines(spark, sf).withColumnRenamed("path", "file")
    here = rows.where((F.col("file") * 3 + F.col("line_no")) % 11 == 0)
    target = F.when(F.col("line_no") % 2 == 0, F.col("file") * 2 + 1).otherwise(F.floor(F.col("file") / 3))
    known = read_table(spark, sf, "documents").select(F.col("doc_id").alias("t"), F.lit(True).alias("there"))
    none = (F.col("file") + F.col("line_no")) % 4 == 0
    named = here.select("file", "line_no", target.alias("t")).join(known, "t", "left").where(F.col("there") | none)
    return rows, named.select("file", "line_no", F.when(~none, F.col("t")).alias("target"))


_PLACES_SQL = (
    "ex AS (SELECT doc_id AS root, doc_id AS file, []::BIGINT[] AS key, [doc_id] AS stack FROM documents UNION ALL "
    "SELECT ex.root, ic.target, list_append(key, ic.line_no), list_append(stack, ic.target) FROM ex JOIN ic USING (file) WHERE ic.target IS NOT NULL AND NOT list_contains(stack, ic.target) AND len(stack) < 4)"
)


@query(
    f"WITH RECURSIVE {_INCLUDES_SQL}, {_PLACES_SQL} SELECT ex.root, row_number() OVER (PARTITION BY ex.root ORDER BY list_append(key, li.line_no)) - 1 AS out_line, ex.file, CAST(li.line_no AS INTEGER) AS line_no, len(stack) AS depth, md5(raw) AS digest "
    "FROM ex JOIN li USING (file) WHERE NOT EXISTS (SELECT 1 FROM ic WHERE ic.file = li.file AND ic.line_no = li.line_no)"
)
def spliced_lines(spark, sf):
    """Each document with the documents that it includes spliced in, at most four deep; some are included twice, some include each other."""
    rows, named = _include_lines(spark, sf)
    places, _ = includes.expansions(named, read_table(spark, sf, "documents").select(F.col("doc_id").alias("root")), 4)
    found = includes.spliced(rows, named, places)
    return found.select("root", F.col("out_line").cast("long").alias("out_line"), "file", "line_no", F.col("depth").cast("long").alias("depth"), F.md5("raw").alias("digest"))


@query(
    f"WITH RECURSIVE {_INCLUDES_SQL}, {_PLACES_SQL} SELECT ex.root, ex.file, CAST(ic.line_no AS INTEGER) AS line_no, CASE WHEN target IS NULL THEN 'missing' WHEN list_contains(stack, target) THEN 'cycle' ELSE 'depth' END AS problem, CAST(count(*) AS BIGINT) AS n "
    "FROM ex JOIN ic USING (file) WHERE target IS NULL OR list_contains(stack, target) OR len(stack) >= 4 GROUP BY ALL"
)
def include_problems(spark, sf):
    _, named = _include_lines(spark, sf)
    _, problems = includes.expansions(named, read_table(spark, sf, "documents").select(F.col("doc_id").alias("root")), 4)
    return problems.groupBy("root", "file", "line_no", "problem").agg(F.count("*").alias("n"))


_FOREST_SQL = (
    "nd AS (SELECT o_custkey AS forest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS node, count(*) OVER (PARTITION BY o_custkey) AS k, o_orderkey FROM orders), "
    "ed AS (SELECT DISTINCT forest, src, unnest([src * 2 + 1, (src * 3) % k, src * 2 + 2]) AS dst, unnest([0, 1, 2]) AS ord, k FROM (SELECT forest, node AS src, k FROM nd)), "
    "ee AS (SELECT forest, src, dst, ord, row_number() OVER (PARTITION BY forest, src ORDER BY ord DESC) = 1 AS last FROM ed WHERE dst < k AND dst <> src), "
    "rt AS (SELECT DISTINCT forest, r AS ord, CASE r WHEN 0 THEN 0 ELSE k // 2 END AS node FROM nd, (SELECT unnest([0, 1]) AS r) WHERE r = 0 OR k > 1)"
)


@query(
    f"WITH RECURSIVE {_FOREST_SQL}, "
    # work: what is still to be shown, next one last: node, how it stands, bars before it
    "sx AS (SELECT forest, list({'node': node, 'text': '● ' || node || '  [root]', 'bars': '', 'root': ord, 'head': true} ORDER BY ord DESC) AS work, []::BIGINT[] AS seen, NULL::BIGINT AS root_ord, NULL::VARCHAR AS line, 0 AS n FROM rt GROUP BY forest UNION ALL "
    "SELECT s.forest, CASE WHEN NOT top.head AND list_contains(seen, top.node) THEN work[1 : len(work) - 1] ELSE list_concat(work[1 : len(work) - 1], coalesce(c.more, [])) END, list_append(seen, top.node), top.root, "
    "CASE WHEN top.head THEN top.text WHEN list_contains(seen, top.node) THEN top.text || '  (seen)' ELSE top.text END, n + 1 "
    "FROM (SELECT *, work[len(work)] AS top FROM sx WHERE len(work) > 0) s LEFT JOIN LATERAL (SELECT list({'node': dst, 'text': s.top.bars || CASE WHEN last THEN '└─ ' ELSE '├─ ' END || '[k' || ord || '] ' || dst, 'bars': s.top.bars || CASE WHEN last THEN '    ' ELSE '│   ' END, 'root': s.top.root, 'head': false} ORDER BY ord DESC) AS more FROM ee WHERE ee.forest = s.forest AND ee.src = s.top.node) c ON true) "
    "SELECT forest, CAST(root_ord AS BIGINT) AS root_ord, CAST(row_number() OVER (PARTITION BY forest, root_ord ORDER BY n) - 1 AS INTEGER) AS line_no, line FROM sx WHERE n > 0"
)
def rendered_forest(spark, sf):
    """Graphs with shared nodes and cycles as text, one forest a customer with two roots."""
    by = Window.partitionBy("o_custkey")
    nodes = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("forest"), (F.row_number().over(by.orderBy("o_orderkey")) - 1).cast("long").alias("node"), F.count("*").over(by).alias("k"))
    n = F.col("node")
    each = nodes.select("forest", n.alias("src"), "k", F.posexplode(F.array(n * 2 + 1, (n * 3) % F.col("k"), n * 2 + 2)).alias("ord", "dst"))
    edges = each.where("dst < k and dst <> src").select("forest", F.concat(F.lit("k"), F.col("ord").cast("string")).alias("kind"), "src", "dst", "ord")
    first = nodes.where("node = 0")
    roots = first.select("forest", F.lit(0).cast("long").alias("node"), F.lit(0).alias("ord")).unionByName(first.where("k > 1").select("forest", F.floor(F.col("k") / 2).alias("node"), F.lit(1).alias("ord")))
    return graph.rendered_forest(edges, roots, nodes.select("forest", "node", n.cast("string").alias("caption")))


@query(
    "WITH sc AS (SELECT s_suppkey AS path, l * 1000 + j AS scope, j * (500 >> l) AS first, (j + 1) * (500 >> l) AS stop FROM supplier, (SELECT l, unnest(range(1 << l)) AS j FROM (SELECT unnest([0, 1, 2]) AS l))), "
    "de AS (SELECT l_suppkey AS path, l_returnflag AS name, l_partkey % 500 AS line, (l_linenumber % 3) * 1000 + (l_partkey % 500) // (500 >> (l_linenumber % 3)) AS scope, l_orderkey * 10 + l_linenumber AS symbol FROM lineitem WHERE l_linenumber <= 3), "
    "us AS (SELECT l_suppkey AS path, l_returnflag AS name, l_partkey % 500 AS line, l_orderkey * 10 + l_linenumber AS use_id FROM lineitem WHERE l_linenumber > 3), "
    "fo AS (SELECT us.path, us.name, us.line, arg_max(row(symbol, de.scope), row(sc.first, -sc.stop, de.line, symbol)) AS x FROM (SELECT DISTINCT path, name, line FROM us) us JOIN de ON de.path = us.path AND de.name = us.name AND de.line <= us.line JOIN sc ON sc.path = de.path AND sc.scope = de.scope AND us.line < sc.stop GROUP BY ALL) "
    "SELECT use_id, x[1] AS symbol, x[2] AS scope FROM us LEFT JOIN fo USING (path, name, line)"
)
def visible_names(spark, sf):
    """Each use with the declaration that holds at its line."""
    level = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("l")
    size = F.call_function("shiftright", F.lit(500), F.col("l"))
    scopes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), level).select("path", "l", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("l")) - 1)).alias("j"))
    scopes = scopes.select("path", (F.col("l") * 1000 + F.col("j")).cast("long").alias("scope"), (F.col("j") * size).alias("first"), ((F.col("j") + 1) * size).alias("end"))
    item = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("name"), (F.col("l_partkey") % 500).alias("line"), (F.col("l_linenumber") % 3).alias("l"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    declared = item.where("n <= 3").select("path", "name", "line", (F.col("l") * 1000 + F.floor(F.col("line") / size)).alias("scope"), F.col("id").alias("symbol"))
    return symbols.visible(item.where("n > 3").select("path", "name", "line", F.col("id").alias("use_id")), declared, scopes).select("use_id", "symbol", "scope")


_PATH_SQL = (
    "pa AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv' WHEN 1 THEN '//host' WHEN 2 THEN '' ELSE '..' END || CASE page_id % 3 WHEN 0 THEN '/a/./b/../' WHEN 1 THEN '/x//y/../../' ELSE '/../q/' END || regexp_replace(url, '^[a-z]*://', '') || CASE page_id % 5 WHEN 0 THEN '/..' WHEN 1 THEN '/' WHEN 2 THEN '/.' ELSE '' END AS p FROM pages), "
    # parts of no effect go, then a name and the .. after it, one pair a step
    "rw AS (SELECT page_id, p AS whole, CASE WHEN p LIKE '//%' AND p NOT LIKE '///%' THEN '//' WHEN p LIKE '/%' THEN '/' ELSE '' END AS root, [x FOR x IN string_split(p, '/') IF x NOT IN ('', '.')] AS parts FROM pa UNION ALL "
    "SELECT page_id, whole, root, list_concat(parts[1 : pos - 1], parts[pos + 2 :]) FROM (SELECT *, list_position([parts[i] <> '..' AND parts[i + 1] = '..' FOR i IN range(1, len(parts))], true) AS pos FROM rw) WHERE pos > 0), "
    "dn AS (SELECT page_id, whole, root, arg_min(parts, len(parts)) AS parts FROM rw GROUP BY ALL), "
    "nf AS (SELECT page_id, whole, CASE WHEN root = '' AND len(parts) = 0 THEN '.' ELSE root || array_to_string(CASE WHEN root = '' THEN parts ELSE [x FOR x IN parts IF x <> '..'] END, '/') END AS normal FROM dn)"
)


def _page_paths(spark, sf):
    n = F.col("page_id")
    head = F.when(n % 4 == 0, "/srv").when(n % 4 == 1, "//host").when(n % 4 == 2, "").otherwise("..")
    middle = F.when(n % 3 == 0, "/a/./b/../").when(n % 3 == 1, "/x//y/../../").otherwise("/../q/")
    tail = F.when(n % 5 == 0, "/..").when(n % 5 == 1, "/").when(n % 5 == 2, "/.").otherwise("")
    return read_table(spark, sf, "pages").select("page_id", F.concat(head, middle, F.regexp_replace("url", "^[a-z]*://", ""), tail).alias("p"))


@query(f"WITH RECURSIVE {_PATH_SQL} SELECT page_id, normal FROM nf")
def normal_paths(spark, sf):
    return _page_paths(spark, sf).select("page_id", normal_path(F.col("p")).alias("normal"))


@query(f"WITH RECURSIVE {_PATH_SQL}, j AS (SELECT a.normal AS src, b.normal AS dst FROM nf a JOIN nf b ON b.page_id = a.page_id // 2) SELECT DISTINCT 'link' AS kind, src, dst FROM j WHERE src <> dst")
def normal_include_edges(spark, sf):
    """Edges between files that are written in several ways."""
    pages = _page_paths(spark, sf)
    linked = pages.select(F.floor(F.col("page_id") / 2).alias("to"), F.col("p").alias("src")).join(pages.select(F.col("page_id").alias("to"), F.col("p").alias("dst")), "to")
    return graph.normal_edges(linked.select(F.lit("link").alias("kind"), "src", "dst"))


_WRAP_SQL = (
    "wl AS (SELECT path, line_no, CASE WHEN (path + line_no) % 3 = 0 THEN raw ELSE repeat(' ', CAST(path % 5 AS INTEGER)) || '//' || raw END AS raw, path % 5 AS lead, (path + line_no) % 3 > 0 AS marked FROM (" + _LINES_SQL + ")), "
    "wx AS (SELECT *, length(raw) > 80 AND marked AND trim(substr(raw, lead + 3), ' ' || chr(9)) <> '' AS wide FROM wl), "
    "ww AS (SELECT path, line_no, lead, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT path, line_no, lead, [x FOR x IN string_split_regex(substr(raw, lead + 3), '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS x FROM wx WHERE wide)), "
    "wc AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY path, line_no ORDER BY i) AS stop FROM ww), "
    # the last word that fits behind word i: ends within 77 - lead characters of where i begins
    "wn AS (SELECT *, max(i) OVER (PARTITION BY path, line_no ORDER BY stop RANGE BETWEEN CURRENT ROW AND (greatest(0, 77 - lead - length(w))) FOLLOWING) AS upto FROM wc), "
    "wp AS (SELECT path, line_no, i, upto, 0 AS part_no FROM wn WHERE i = 1 UNION ALL SELECT wn.path, wn.line_no, wn.i, wn.upto, part_no + 1 FROM wp JOIN wn ON wn.path = wp.path AND wn.line_no = wp.line_no AND wn.i = wp.upto + 1), "
    "wo AS (SELECT wp.path, wp.line_no, part_no, repeat(' ', CAST(any_value(lead) AS INTEGER)) || '// ' || string_agg(w, ' ' ORDER BY ww.i) AS part FROM wp JOIN ww ON ww.path = wp.path AND ww.line_no = wp.line_no AND ww.i BETWEEN wp.i AND wp.upto GROUP BY ALL)"
)


@query(f"WITH RECURSIVE {_WRAP_SQL} SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(part_no AS INTEGER) AS part_no, md5(part) AS digest FROM (SELECT path, line_no, part_no, part FROM wo UNION ALL SELECT path, line_no, 0, raw FROM wx WHERE NOT wide)")
def wrapped_comments(spark, sf):
    """Comment lines of over eighty characters filled anew; other lines stay."""
    n = F.col("path") + F.col("line_no")
    marked = F.when(n % 3 == 0, F.col("raw")).otherwise(F.concat(F.repeat(F.lit(" "), (F.col("path") % 5).cast("int")), F.lit("//"), "raw"))
    return layout.wrapped(_lines(spark, sf).withColumn("raw", marked), 80).select("path", "line_no", F.col("part_no"), F.md5("part").alias("digest"))


_OPERATORS = ("+", "-", "*", "/", "%", "&", "|", "<")
_CHAIN_SQL = (
    "it AS (SELECT l_orderkey AS path, row_number() OVER w AS k, CASE WHEN l_suppkey % 17 > 0 THEN l_partkey % 100 - 50 END AS own FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), "
    "ch AS (SELECT path, k, own::BIGINT AS v FROM it WHERE k = 1 UNION ALL SELECT ch.path, it.k, CASE (ch.path + ch.k) % 8 WHEN 0 THEN TRY_CAST(v::HUGEINT + own AS BIGINT) WHEN 1 THEN TRY_CAST(v::HUGEINT - own AS BIGINT) WHEN 2 THEN TRY_CAST(v::HUGEINT * own AS BIGINT) "
    "WHEN 3 THEN CASE WHEN own <> 0 THEN v // own END WHEN 4 THEN CASE WHEN own <> 0 THEN v % own END WHEN 5 THEN v & own WHEN 6 THEN v | own ELSE CAST(v < own AS BIGINT) END FROM ch JOIN it ON it.path = ch.path AND it.k = ch.k + 1)"
)


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT path, arg_max(coalesce(v, -999999), k) AS value FROM ch GROUP BY path")
def folded_constants(spark, sf):
    """Values of constant expressions: the lines of an order, combined from the left by eight operators; unknown ones as -999999."""
    by = Window.partitionBy("tree")
    item = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tree"), "l_linenumber", "l_partkey", "l_suppkey")
    item = item.select("tree", F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("k"), F.count("*").over(by).alias("n"), F.when(F.col("l_suppkey") % 17 > 0, F.col("l_partkey") % 100 - 50).alias("own"))
    k, n = F.col("k"), F.col("n")
    turn = F.get(F.array(*map(F.lit, _OPERATORS)), ((F.col("tree") + k) % 8).cast("int"))
    above = F.get(F.array(*map(F.lit, _OPERATORS)), ((F.col("tree") + F.greatest(k - 1, F.lit(1))) % 8).cast("int"))
    after = F.get(F.array(*map(F.lit, _OPERATORS)), ((F.col("tree") + k + 1) % 8).cast("int"))
    none = F.lit(None).cast("long")
    # a row for the leaf and, but for the last item, one for the operator over it; an array of structs of all this is not compiled
    each = item.select("*", F.explode(F.when(k < n, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("inner"))
    of = lambda inner, leaf: F.when(F.col("inner"), inner).otherwise(leaf)
    nodes = each.select(
        "tree", of(n - 1 - k, n + k - 2).alias("node"), of(2 * k + 1, F.lit(1).cast("long")).alias("size"), of(F.when(k < n - 1, n - 2 - k), F.when(n > 1, n - F.greatest(k, F.lit(2)))).alias("parent"),
        of(F.when(k < n - 1, after), F.when(n > 1, above)).alias("parent_kind"), F.when(F.col("inner") | (k == 1), 0).otherwise(1).alias("ord"), of(turn, F.lit("leaf")).alias("kind"), of(none, F.col("own")).alias("own"),
    )
    found = trees.folded(nodes, trees.CONSTANTS).where("parent is null")
    return found.select(F.col("tree").alias("path"), F.coalesce("value", F.lit(-999999)).alias("value"))


@query(
    "SELECT l_orderkey AS path, l_linenumber AS line_no, l_partkey AS k, CASE l_suppkey % 6 WHEN 0 THEN CAST(l_linenumber < l_quantity / 10 AS INTEGER) WHEN 1 THEN CAST(l_linenumber <= l_quantity / 10 AS INTEGER) WHEN 2 THEN CAST(l_linenumber > l_quantity / 10 AS INTEGER) WHEN 3 THEN CAST(l_linenumber >= l_quantity / 10 AS INTEGER) WHEN 4 THEN CAST(l_linenumber <> l_quantity / 10 AS INTEGER) ELSE -1 END AS runs FROM lineitem"
)
def loop_executions(spark, sf):
    """Whether loops surely run once: 1, 0, or -1 where it is not known."""
    s = F.col("l_suppkey") % 6
    op = F.when(s == 0, "<").when(s == 1, "<=").when(s == 2, ">").when(s == 3, ">=").when(s == 4, "!=").otherwise("in")
    runs = trees.loop_runs(F.col("l_linenumber"), op, F.col("l_quantity") / 10)
    return read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("k"), F.coalesce(runs.cast("int"), F.lit(-1)).alias("runs"))


@query(
    f"WITH dl AS (SELECT path, line_no, CASE (path + line_no) % 3 WHEN 0 THEN '  #  define ' ELSE '' END || raw AS raw FROM ({_LINES_SQL})), b AS (SELECT path, line_no, ltrim(substr(ltrim(raw, ' ' || chr(9)), 2), ' ' || chr(9)) AS body FROM dl WHERE starts_with(ltrim(raw, ' ' || chr(9)), '#')) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, regexp_extract(body, '^(\\S*)', 1) AS name, md5(regexp_extract(body, '^\\S*\\s+(.*)$', 1)) AS digest FROM b"
)
def directive_lines(spark, sf):
    """Directives read from raw lines: their name and what follows."""
    n = F.col("path") + F.col("line_no")
    marked = _lines(spark, sf).withColumn("raw", F.concat(F.when(n % 3 == 0, "  #  define ").otherwise(""), "raw"))
    return directives.directive_lines(marked, "#").select("path", "line_no", "name", F.md5("rest").alias("digest"))


@query(
    "WITH t AS (SELECT l_orderkey AS path, l_linenumber AS line_no, l_partkey AS k, CASE l_suppkey % 4 WHEN 0 THEN 'sig' || l_partkey || '[' || l_linenumber || ':0]' WHEN 1 THEN ' { a_' || l_partkey || ', b }' WHEN 2 THEN l_partkey || 'x' ELSE '_q$' || l_partkey || '.f' END AS target, l_suppkey % 4 AS s FROM lineitem) "
    "SELECT path, line_no, k, CASE s WHEN 0 THEN 'sig' || k WHEN 1 THEN 'a_' || k WHEN 2 THEN '' ELSE '_q$' || k END AS signal FROM t"
)
def target_signals(spark, sf):
    """The signal that an assignment's target names first."""
    s, k = F.col("l_suppkey") % 4, F.col("l_partkey").cast("string")
    target = F.when(s == 0, F.concat(F.lit("sig"), k, F.lit("["), F.col("l_linenumber").cast("string"), F.lit(":0]"))).when(s == 1, F.concat(F.lit(" { a_"), k, F.lit(", b }"))).when(s == 2, F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit("_q$"), k, F.lit(".f")))
    return read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("k"), root_signal(target).alias("signal"))
