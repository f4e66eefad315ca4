"""Queries over conditional regions, line maps and edits, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import TAIL
from ..operators import conditions, directives, layout, linemap, lines
from ..sources.tables import read_table
from .queries import _LINES_SQL, _lines, query

#: Some lines stand for conditional marks, since the documents have none.
_OP_SQL = "CASE (path * 7 + line_no * 5) % 13 WHEN 0 THEN 'if' WHEN 1 THEN 'else' WHEN 2 THEN 'endif' END"
_MARKS_SQL = f"l AS (SELECT *, {_OP_SQL} AS op, 'N' || ((path + line_no) % 3) AS name FROM ({_LINES_SQL}))"
_BRANCHES_SQL = (
    f"{_MARKS_SQL}, s AS (SELECT *, sum(CASE op WHEN 'if' THEN 1 WHEN 'endif' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS s FROM l WHERE op IS NOT NULL), "
    "d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_no)) AS depth FROM s), "
    "e AS (SELECT *, CASE WHEN op = 'endif' THEN coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line_no), 0) ELSE depth END AS level FROM d), "
    "b AS (SELECT *, sum(CASE WHEN op = 'if' THEN 1 ELSE 0 END) OVER (PARTITION BY path, level ORDER BY line_no) AS block FROM e WHERE level > 0), "
    "r AS (SELECT path, level, block, line_no AS line, op, first(name) OVER w AS name, row_number() OVER w - 1 AS branch, lead(line_no) OVER w AS stop FROM b WINDOW w AS (PARTITION BY path, level, block ORDER BY line_no)), "
    "br AS (SELECT * FROM r WHERE op <> 'endif')"
)
_OFF_SQL = "br.branch <> CASE WHEN br.name = 'N1' THEN 0 ELSE 1 END"
_ACTIVE_SQL = f"a AS (SELECT path, line_no, raw, op, NOT EXISTS (SELECT 1 FROM br WHERE br.path = l.path AND br.line <= l.line_no AND (br.stop IS NULL OR br.stop > l.line_no) AND {_OFF_SQL}) AS active FROM l)"


def _marked(spark, sf):
    n = (F.col("path") * 7 + F.col("line_no") * 5) % 13
    op = F.when(n == 0, "if").when(n == 1, "else").when(n == 2, "endif")
    return _lines(spark, sf).withColumn("op", op).withColumn("name", F.concat(F.lit("N"), ((F.col("path") + F.col("line_no")) % 3).cast("string")))


def _branches(spark, sf):
    return conditions.branches(_marked(spark, sf).where("op is not null").select("path", F.col("line_no").alias("line"), "op", "name"))


@query(f"WITH {_BRANCHES_SQL}, {_ACTIVE_SQL} SELECT path, CAST(line_no AS INTEGER) AS line_no FROM a WHERE active AND op IS NULL")
def active_lines(spark, sf):
    """Lines that are active where only N1 is defined."""
    off = conditions.untaken(_branches(spark, sf), F.col("name") == "N1")
    return conditions.active_lines(_marked(spark, sf).where("op is null").select("path", "line_no"), off, ["path"]).select("path", "line_no")


@query(f"WITH {_BRANCHES_SQL} SELECT path, CAST(min(line) AS INTEGER) AS line, any_value(name) AS name FROM br GROUP BY path, level, block HAVING bool_or(stop IS NULL)")
def unclosed_conditions(spark, sf):
    return conditions.unclosed(_branches(spark, sf))


@query(
    f"WITH {_BRANCHES_SQL}, {_ACTIVE_SQL}, c AS (SELECT path, line_no, active, sum(CASE WHEN active = p THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no) AS run "
    "FROM (SELECT *, lag(active) OVER (PARTITION BY path ORDER BY line_no) AS p FROM a)) "
    "SELECT path, CAST(min(line_no) AS INTEGER) AS first, CAST(max(line_no) + 1 AS INTEGER) AS stop FROM c WHERE NOT active GROUP BY path, run"
)
def inactive_regions(spark, sf):
    all_lines = _marked(spark, sf).select("path", "line_no")
    off = conditions.untaken(_branches(spark, sf), F.col("name") == "N1")
    active = conditions.active_lines(all_lines, off, ["path"]).select("path", "line_no", F.lit(True).alias("active"))
    flags = all_lines.join(active, ["path", "line_no"], "left").withColumn("flag", F.col("active").isNull())
    return conditions.regions(flags, ["path"]).withColumnRenamed("end", "stop")


_CONFIGS_SQL = (
    "arms AS (SELECT path, level, block, min(line) AS line, greatest(max(branch) + 1, 2) AS n FROM br GROUP BY ALL), "
    "weighed AS (SELECT *, coalesce(product(n) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS weight, product(n) OVER (PARTITION BY path) AS total FROM arms), "
    "cf AS (SELECT path, config, level, block, total, CASE WHEN weight >= 6 THEN 0 ELSE CAST((config // CAST(weight AS BIGINT)) % n AS INTEGER) END AS arm FROM (SELECT *, unnest(range(CAST(least(total, 6) AS BIGINT))) AS config FROM weighed))"
)


@query(f"WITH {_BRANCHES_SQL}, {_CONFIGS_SQL} SELECT path, config, level, block, arm, total AS n_all FROM cf")
def condition_configurations(spark, sf):
    """At most six configurations a path, as the bound of the operator."""
    return conditions.configurations(_branches(spark, sf), 6)


@query(
    f"WITH {_BRANCHES_SQL}, {_CONFIGS_SQL}, tl AS (SELECT path, line_no, op, CASE WHEN (path + line_no) % 7 = 0 THEN raw || ' ' || chr(9) WHEN (path + line_no) % 5 = 0 THEN 'a' || chr(9) || raw ELSE raw END AS raw FROM l), "
    "fi AS (SELECT path, line_no, 'ST001' AS code FROM tl WHERE op IS NULL AND regexp_matches(raw, '[ \\t]+$') UNION ALL SELECT path, line_no, 'ST002' FROM tl WHERE op IS NULL AND contains(rtrim(raw, ' ' || chr(9)), chr(9)) UNION ALL SELECT path, line_no, 'ST003' FROM tl WHERE op IS NULL AND length(raw) > 100), "
    "each AS (SELECT f.path, f.line_no, f.code, coalesce(c.config, 0) AS config FROM fi f LEFT JOIN (SELECT DISTINCT path, config FROM cf) c USING (path)), "
    "held AS (SELECT * FROM each e WHERE NOT EXISTS (SELECT 1 FROM br JOIN cf USING (path, level, block) WHERE br.path = e.path AND cf.config = e.config AND br.branch <> cf.arm AND br.line <= e.line_no AND (br.stop IS NULL OR br.stop > e.line_no))) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, code, string_agg(CAST(config AS VARCHAR), ' ' ORDER BY config) AS configs, coalesce(any_value(t.n_tried), 1) AS n_tried, coalesce(any_value(t.n_all), 1.0) AS n_all "
    "FROM held LEFT JOIN (SELECT path, count(DISTINCT config) AS n_tried, max(total) AS n_all FROM cf GROUP BY path) t USING (path) GROUP BY path, line_no, code"
)
def findings_in_all_configurations(spark, sf):
    """The findings of all line checks, each with the configurations in which its line is active."""
    found = _branches(spark, sf)
    n = F.col("path") + F.col("line_no")
    raw = F.when(n % 7 == 0, F.concat("raw", F.lit(" \t"))).when(n % 5 == 0, F.concat(F.lit("a\t"), "raw")).otherwise(F.col("raw"))
    all_ = lines.style(_marked(spark, sf).where("op is null").withColumn("raw", raw), 100)
    merged = conditions.merged_findings(all_, found, conditions.configurations(found, 6))
    return merged.select("path", "line_no", "code", F.array_join(F.transform("configs", lambda x: x.cast("string")), " ").alias("configs"), "n_tried", "n_all")


@query(
    f"WITH {_BRANCHES_SQL}, x AS (SELECT l.*, d.depth FROM l LEFT JOIN d USING (path, line_no)), y AS (SELECT *, coalesce(last_value(depth IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no), 0) AS inside FROM x) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, md5(CASE WHEN trim(raw, ' ' || chr(9)) = '' THEN '' ELSE repeat(' ', CAST(4 * greatest(0, inside - CASE WHEN op IN ('if', 'else') THEN 1 ELSE 0 END) AS INTEGER)) || trim(raw, ' ' || chr(9)) END) AS digest FROM y"
)
def conditional_indent(spark, sf):
    """Lines indented by the blocks around them; marks stand with their block."""
    by = layout.Window.partitionBy("path").orderBy("line_no")
    summed = _marked(spark, sf).withColumn("s", F.sum(F.when(F.col("op") == "if", 1).when(F.col("op") == "endif", -1).otherwise(0)).over(by))
    depth = F.col("s") - F.least(F.lit(0), F.min("s").over(by)) - F.coalesce(F.col("op").isin("if", "else"), F.lit(False)).cast("int")
    return layout.indented(summed.withColumn("depth", depth)).select("path", "line_no", F.md5("indented").alias("digest"))


@query(
    f"WITH {_BRANCHES_SQL} SELECT l.path, CAST(l.line_no AS INTEGER) AS line_no, md5(CASE WHEN r.name IS NULL OR suffix(l.raw, '// ' || r.name) THEN l.raw ELSE rtrim(l.raw, ' ') || ' // ' || r.name END) AS digest "
    "FROM l LEFT JOIN (SELECT path, line AS line_no, name FROM r WHERE op <> 'if') r USING (path, line_no)"
)
def annotated_conditions(spark, sf):
    marked = _marked(spark, sf)
    found = _branches(spark, sf)
    last = found.where("end is not null").join(marked.where("op = 'endif'").select("path", F.col("line_no").alias("end")), ["path", "end"]).select("path", F.col("end").alias("line"), "name")
    return conditions.annotated(found, last, marked.select("path", "line_no", "raw")).select("path", "line_no", F.md5("annotated").alias("digest"))


_FINDINGS_SQL = "f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_suppkey AS path, l_partkey % 500 AS line FROM lineitem)"


def _findings(spark, sf):
    return read_table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 500).alias("line"))


@query(
    f"WITH {_FINDINGS_SQL}, m AS (SELECT DISTINCT l_suppkey AS path, l_partkey % 500 AS line, (l_suppkey + l_partkey % 500) * 2 + 1 AS src FROM lineitem WHERE l_linenumber = 1) "
    "SELECT finding_id, f.path, coalesce(src - 1, f.line) AS source_line FROM f LEFT JOIN m USING (path, line)"
)
def mapped_findings(spark, sf):
    mapped = read_table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 500).alias("out_line")).distinct()
    return linemap.source_lines(_findings(spark, sf), mapped.withColumn("src_line", (F.col("path") + F.col("out_line")) * 2 + 1)).select("finding_id", "path", "source_line")


@query(
    f"WITH {_FINDINGS_SQL}, g AS (SELECT o_custkey % 100 + 1 AS path, o_orderpriority AS macro, o_orderkey % 500 AS first, o_orderkey % 500 + 4 AS stop, o_orderkey AS ord FROM orders) "
    "SELECT finding_id, (SELECT min_by(macro, ord) FROM g WHERE g.path = f.path AND f.line >= g.first AND f.line < g.stop) AS macro FROM f"
)
def macros_of_findings(spark, sf):
    o = F.col("o_orderkey")
    found = read_table(spark, sf, "orders").select((F.col("o_custkey") % 100 + 1).alias("path"), F.col("o_orderpriority").alias("macro"), (o % 500).alias("first"), (o % 500 + 4).alias("end"), o.alias("ord"))
    return linemap.macro_of_line(_findings(spark, sf), found).select("finding_id", "macro")


@query(
    "WITH d AS (SELECT user_id AS path, event_type AS name, event_id AS line FROM events WHERE event_id % 3 > 0), "
    "c AS (SELECT user_id AS path, event_type AS name, event_id AS call_id, CASE WHEN event_id % 2 = 0 THEN event_id - 40 ELSE event_id END AS line FROM events WHERE event_id % 3 = 0) "
    "SELECT c.path, c.name, c.call_id, c.line AS source_line, d.line AS defined_at FROM c ASOF JOIN d ON c.path = d.path AND c.name = d.name AND c.line >= d.line"
)
def mapped_invocations(spark, sf):
    """Calls brought back to source lines, each with the definition in force there."""
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("line"))
    defined = e.where("line % 3 > 0").select("path", "name", "line", F.col("line").alias("seq"), F.array(F.col("line").cast("string")).alias("params"))
    back = e.where("line % 2 = 0").select("path", F.col("line").alias("out_line"), (F.col("line") - 39).alias("src_line"))
    calls = linemap.source_lines(e.where("line % 3 = 0").withColumn("call_id", F.col("line")), back)
    placed = directives.in_force(calls.select("path", "name", F.col("source_line").alias("line"), "call_id"), defined)
    return placed.select("path", "name", "call_id", F.col("line").alias("source_line"), F.col("params")[0].cast("long").alias("defined_at"))


@query(
    "WITH s AS (SELECT o_custkey AS path, o_orderkey AS node, o_orderkey % 1000 AS first, o_orderkey % 1000 + (o_orderkey % 7 + 1) * 100 AS stop FROM orders), "
    "e AS (SELECT c_custkey AS path, c_custkey % 900 + 50 AS a, c_custkey % 900 + 60 AS b FROM customer) "
    "SELECT s.path, s.node, CAST(row_number() OVER (PARTITION BY s.path ORDER BY stop - first DESC, first, node) - 1 AS INTEGER) AS depth, (b - a) / (stop - first)::DOUBLE <= 0.2 + 0.1 * least(node, 20000) / 20000 AS small FROM s JOIN e USING (path) WHERE first <= a AND b <= stop"
)
def covering_spans(spark, sf):
    """Spans around an edit, outermost first, and whether the edit is small enough for incremental work there."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    spans = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), o.alias("node"), (o % 1000).alias("first"), (o % 1000 + (o % 7 + 1) * 100).alias("end"))
    edits = read_table(spark, sf, "customer").select(c.alias("path"), (c % 900 + 50).alias("edit_first"), (c % 900 + 60).alias("edit_end"))
    found = linemap.covering_spans(spans, edits).join(spans, ["path", "node"])
    small = (F.col("edit_end") - F.col("edit_first")) / (F.col("end") - F.col("first")) <= linemap.change_ratio_limit(F.col("node"))
    return found.select("path", "node", "depth", small.alias("small"))


@query(
    "WITH d AS (SELECT doc_id AS path, text FROM documents WHERE text IS NOT NULL), k AS (SELECT *, unnest(range(least(5, length(text) // 50))) AS k FROM d), "
    "p AS (SELECT path, k, k * 40 + path % 7 AS first, k * 40 + path % 7 + 5 AS stop, text FROM k), "
    "j AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY path ORDER BY k), 0) AS last FROM p), "
    "x AS (SELECT path, string_agg(substr(text, last + 1, first - last) || '<' || k || '>', '' ORDER BY k) || substr(any_value(text), max(stop) + 1) AS text FROM j GROUP BY path) "
    "SELECT d.path, md5(coalesce(x.text, d.text)) AS digest FROM d LEFT JOIN x USING (path)"
)
def applied_edits(spark, sf):
    docs = read_table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    n = F.least(F.lit(5), F.floor(F.length("text") / 50).cast("int"))
    each = docs.where(n > 0).select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    first = (F.col("k") * 40 + F.col("path") % 7).cast("int")
    edits = each.select("path", first.alias("first"), (first + 5).alias("end"), F.concat(F.lit("<"), F.col("k").cast("string"), F.lit(">")).alias("new"))
    return linemap.apply_edits(docs, edits).select("path", F.md5("text").alias("digest"))


@query(
    f"WITH t AS (SELECT path, line_no, unnest(string_split(regexp_replace(raw, '\\. ', '.' || chr(10), 'g'), chr(10))) AS part, generate_subscripts(string_split(regexp_replace(raw, '\\. ', '.' || chr(10), 'g'), chr(10)), 1) - 1 AS part_no FROM ({_LINES_SQL})) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(part_no AS INTEGER) AS part_no, md5(part) AS digest FROM t"
)
def split_lines(spark, sf):
    """Lines split where a pattern ends, as statements that share a line are."""
    return lines.split_after(_lines(spark, sf), r"\.", " ").select("path", "line_no", "part_no", F.md5("part").alias("digest"))
