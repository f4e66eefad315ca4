"""Registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import widths
from ..operators import changes, directives, graph, layout, lines, rules, symbols
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_LINES_SQL = "SELECT doc_id AS path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents"
#: Some lines get a tail or a tab, since the documents have none.
_MARKED_SQL = f"SELECT path, line_no, CASE WHEN (path + line_no) % 7 = 0 THEN raw || ' ' || chr(9) WHEN (path + line_no) % 5 = 0 THEN 'a' || chr(9) || raw ELSE raw END AS raw FROM ({_LINES_SQL})"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.lines(read_table(spark, sf, "documents"), "doc_id", "text")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("path") + F.col("line_no")
    raw = F.when(n % 7 == 0, F.concat("raw", F.lit(" \t"))).when(n % 5 == 0, F.concat(F.lit("a\t"), "raw")).otherwise(F.col("raw"))
    return _lines(spark, sf).withColumn("raw", raw)


@query(f"SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(length(raw) AS INTEGER) AS width FROM ({_LINES_SQL}) WHERE length(raw) > 100")
def style_line_width(spark, sf):
    return lines.wide_lines(_lines(spark, sf), 100).select("path", "line_no", F.col("end").alias("width"))


@query(f"SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(length(rtrim(raw, ' ' || chr(9))) AS INTEGER) AS first, CAST(length(raw) AS INTEGER) AS \"end\" FROM ({_MARKED_SQL}) WHERE regexp_matches(raw, '[ \\t]+$')")
def style_trailing_space(spark, sf):
    return lines.trailing_space(_marked(spark, sf)).select("path", "line_no", "first", "end")


@query(f"SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(instr(rtrim(raw, ' ' || chr(9)), chr(9)) - 1 AS INTEGER) AS first FROM ({_MARKED_SQL}) WHERE instr(rtrim(raw, ' ' || chr(9)), chr(9)) > 0")
def style_tabs(spark, sf):
    return lines.tabs(_marked(spark, sf)).select("path", "line_no", "first")


_KEYWORDS = {"the": "keyword.article", "and": "keyword.and", "der": "keyword.article", "la": "keyword.article"}
_TOKENS_SQL = f"SELECT path, unnest(regexp_extract_all(raw, '{lines.TOKEN}')) AS content FROM ({_LINES_SQL})"


@query(
    f"WITH k(content, named) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in _KEYWORDS.items())}), t AS ({_TOKENS_SQL}) "
    "SELECT coalesce(named, CASE WHEN regexp_matches(t.content, '^[A-Za-z_]') THEN 'id' WHEN regexp_matches(t.content, '^[0-9]') THEN 'literal.number' ELSE 'symbol' END) AS type, "
    "count(*) AS n, count(DISTINCT t.content) AS n_distinct FROM t LEFT JOIN k USING (content) GROUP BY ALL"
)
def token_histogram(spark, sf):
    keywords = spark.createDataFrame(list(_KEYWORDS.items()), "content string, type string")
    return lines.token_counts(_lines(spark, sf), keywords).groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


@query(
    "WITH t AS (SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM (SELECT page_id, regexp_extract_all(html, '[][(){}]') AS x FROM pages)), "
    "d AS (SELECT page_id, c, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t) "
    "SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest, count(*) AS n FROM d WHERE c IN ('(', '[', '{') GROUP BY page_id"
)
def bracket_depth(spark, sf):
    found = lines.tokens(lines.lines(read_table(spark, sf, "pages"), "page_id", "html"), pattern=r"[\[\](){}]")
    opened = lines.bracket_depth(found).where(F.col("content").isin("(", "[", "{"))
    return opened.groupBy(F.col("path").alias("page_id")).agg(F.max(F.col("depth") + 1).alias("deepest"), F.count("*").alias("n"))


@query(
    "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?[a-z][a-z0-9]*')) AS m FROM pages) "
    "SELECT page_id AS path, ltrim(m, '</') AS tag, count(*) FILTER (m NOT LIKE '</%') AS opened, count(*) FILTER (m LIKE '</%') AS closed FROM t GROUP BY ALL HAVING opened <> closed"
)
def tag_balance(spark, sf):
    marks = read_table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit("(</?[a-z][a-z0-9]*)"), F.lit(1))).alias("m"))
    return lines.unbalanced(marks.select("path", F.regexp_replace("m", "^</?", "").alias("tag"), F.when(F.startswith("m", F.lit("</")), -1).otherwise(1).alias("step")))


@query(
    f"WITH l AS (SELECT path, line_no, raw || CASE WHEN (path + line_no) % 3 = 0 THEN '\\' ELSE '' END AS raw FROM ({_LINES_SQL})), "
    "g AS (SELECT *, sum(CASE WHEN coalesce(p, false) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no) AS g FROM (SELECT *, lag(suffix(raw, '\\')) OVER (PARTITION BY path ORDER BY line_no) AS p FROM l)) "
    "SELECT path, CAST(min(line_no) AS INTEGER) AS line_no, md5(string_agg(regexp_replace(raw, '\\\\$', ''), '' ORDER BY line_no)) AS digest FROM g GROUP BY path, g.g"
)
def continued_lines(spark, sf):
    marked = _lines(spark, sf).withColumn("raw", F.concat("raw", F.when((F.col("path") + F.col("line_no")) % 3 == 0, "\\").otherwise("")))
    return lines.joined_lines(marked).select("path", "line_no", F.md5("raw").alias("digest"))


def _events(spark, sf):
    return read_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_EVENTS_SQL = "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"


@query(
    f"WITH e AS (SELECT user_id AS path, event_type AS name, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'undef' ELSE 'define' END AS op, CASE WHEN event_id % 11 > 0 THEN k END AS value FROM ({_EVENTS_SQL})), "
    "w AS (SELECT *, lag(op) OVER (PARTITION BY path, name ORDER BY seq) AS last_op, lag(value) OVER (PARTITION BY path, name ORDER BY seq) AS last_value FROM e) "
    "SELECT path, name, seq, value, last_value FROM w WHERE op = 'define' AND last_op = 'define' AND value <> last_value"
)
def directive_redefinition(spark, sf):
    n = F.col("event_id")
    e = _events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), n.alias("seq"), F.when(n % 5 == 0, "undef").otherwise("define").alias("op"), F.when(n % 11 > 0, F.col("k")).alias("value"))
    return directives.redefinitions(e).select("path", "name", "seq", "value", "last_value")


@query("SELECT user_id AS path, max_by(event_type, event_id) AS value FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'view'")
def directive_last_value(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return directives.last_values(e, "view")


@query(
    f"WITH e AS (SELECT *, user_id AS path, event_type AS name FROM ({_EVENTS_SQL})), "
    "d AS (SELECT path, name, event_id AS line, CASE WHEN k % 4 > 0 THEN k % 4 END AS n_params FROM e WHERE event_id % 3 > 0), "
    "c AS (SELECT path, name, event_id AS line, k % 3 + 1 AS slots FROM e WHERE event_id % 3 = 0), "
    "j AS (SELECT c.*, d.n_params, d.line AS def_line FROM c ASOF JOIN d ON c.path = d.path AND c.name = d.name AND c.line >= d.line) "
    "SELECT path, name, line, slots, n_params FROM j WHERE n_params IS NOT NULL AND slots <> n_params"
)
def macro_in_force(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("line"), "k")
    names = F.transform(F.sequence(F.lit(1), F.col("k") % 4), lambda x: F.concat(F.lit("p"), x.cast("string")))
    defined = e.where("line % 3 > 0").select("path", "name", "line", F.col("line").alias("seq"), F.when(F.col("k") % 4 > 0, names).alias("params"))
    calls = e.where("line % 3 = 0").select("path", "name", "line", (F.col("k") % 3 + 1).alias("slots"), F.lit(False).alias("single_empty"))
    return directives.wrong_argument_counts(directives.in_force(calls, defined)).select("path", "name", "line", "slots", F.size("params").alias("n_params"))


@query(
    "WITH m AS (SELECT user_id AS path, event_id AS line, CASE WHEN event_id % 2 = 0 THEN 'off' ELSE 'on' END AS op FROM events WHERE event_id % 7 = 0), "
    "c AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY path ORDER BY line) AS last FROM m) WHERE op <> coalesce(last, 'on')), "
    "r AS (SELECT path, line AS start, nxt FROM (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line) AS nxt FROM c) WHERE op = 'off'), "
    "d AS (SELECT user_id AS path, CASE WHEN event_id % 13 > 0 THEN event_id END AS line, event_type AS code FROM events WHERE value > 20) "
    "SELECT path, line, code FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = d.path AND d.line >= r.start AND (r.nxt IS NULL OR d.line < r.nxt))"
)
def suppressed_diagnostics(spark, sf):
    e = read_table(spark, sf, "events")
    n = F.col("event_id")
    marks = e.where(n % 7 == 0).select(F.col("user_id").alias("path"), n.alias("line"), F.when(n % 2 == 0, "off").otherwise("on").alias("op"))
    found = e.where("value > 20").select(F.col("user_id").alias("path"), F.when(n % 13 > 0, n).alias("line"), F.col("event_type").alias("code"))
    return directives.unsuppressed(found, directives.suppressed_ranges(marks))


_RULES = (
    rules.NamingRule("N1", "part", "[a-z]+ part", "{kind} '{name}' breaks {id} ({pattern})"),
    rules.NamingRule("N2", "supplier", "Supplier#0+[1-5]", "{name}: {severity}", "error"),
    rules.NamingRule("N3", "customer", "Customer#0+[0-9]*[02468]$", "{name} {unknown}", default=False),
    rules.NamingRule("N4", "customer", "X", "never on", default=False),
)
_USER = rules.UserConfig(severities={"N2": "info"}, per_file={"gen/**": ["N3"]})
_SYMBOLS_SQL = (
    "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'src/gen/a.v' ELSE 'src/b.v' END AS path, p_name AS name, 'part' AS kind FROM part UNION ALL "
    "SELECT 'src/b.v', s_name, 'supplier' FROM supplier UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'src/gen/a.v' ELSE 'src/b.v' END, c_name, 'customer' FROM customer"
)


def _symbols(spark, sf):
    file = lambda c: F.when(F.col(c) % 3 == 0, "src/gen/a.v").otherwise("src/b.v").alias("path")
    part = read_table(spark, sf, "part").select(file("p_partkey"), F.col("p_name").alias("name"), F.lit("part").alias("kind"))
    supplier = read_table(spark, sf, "supplier").select(F.lit("src/b.v").alias("path"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    customer = read_table(spark, sf, "customer").select(file("c_custkey"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return part.unionByName(supplier).unionByName(customer)


_NAMING_SQL = (
    f"WITH s AS ({_SYMBOLS_SQL}), f AS ("
    "SELECT *, 'N1' AS id, 'warning' AS severity, 'part ''' || name || ''' breaks N1 ([a-z]+ part)' AS message FROM s WHERE kind = 'part' AND NOT regexp_matches(name, '^(?:[a-z]+ part)') UNION ALL "
    "SELECT *, 'N2', 'info', name || ': info' FROM s WHERE kind = 'supplier' AND NOT regexp_matches(name, '^(?:Supplier#0+[1-5])') UNION ALL "
    "SELECT *, 'N3', 'warning', '{name} {unknown}' FROM s WHERE kind = 'customer' AND path NOT LIKE '%gen/%' AND NOT regexp_matches(name, '^(?:Customer#0+[0-9]*[02468]$)')) "
)


@query(_NAMING_SQL + "SELECT path, name, kind, id, severity, message FROM f")
def naming_rules(spark, sf):
    return rules.naming_violations(_symbols(spark, sf), _RULES, _USER)


@query(_NAMING_SQL + "SELECT path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM f GROUP BY path")
def severity_tally(spark, sf):
    return rules.severity_tally(rules.naming_violations(_symbols(spark, sf), _RULES, _USER), ["path"])


_NAMED_SQL = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '_' || p_name ELSE p_name END AS name FROM part"


@query(f"SELECT p_partkey, name FROM ({_NAMED_SQL}) WHERE name NOT LIKE '\\_%' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49 AND l_returnflag = 'R')")
def unused_declarations(spark, sf):
    declared = read_table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    used = read_table(spark, sf, "lineitem").where("l_quantity > 49 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return symbols.unused(declared, used, ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def undefined_references(spark, sf):
    references = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    declared = read_table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return symbols.undefined(references, declared, ["l_suppkey"])


_PORTS_SQL = "SELECT n_nationkey AS unit, p.port, p.ord, CASE WHEN (n_nationkey + p.ord) % 4 = 0 THEN 'inout' WHEN p.ord % 2 = 0 THEN 'input' ELSE 'output' END AS direction FROM nation, (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) p(port, ord)"


def _ports(spark, sf):
    named = F.array(*[F.struct(F.lit(p).alias("port"), F.lit(i).alias("ord")) for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))])
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"), F.inline(named))
    direction = F.when((F.col("unit") + F.col("ord")) % 4 == 0, "inout").when(F.col("ord") % 2 == 0, "input").otherwise("output")
    return nation.withColumn("direction", direction)


@query(
    f"WITH p AS ({_PORTS_SQL}), i AS (SELECT c_custkey AS inst, c_nationkey AS unit FROM customer), "
    "c AS (SELECT o_custkey AS inst, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS port, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS ord FROM orders), "
    "g AS (SELECT inst, port FROM c WHERE port IS NOT NULL UNION ALL SELECT c.inst, p.port FROM c JOIN i USING (inst) JOIN p ON p.unit = i.unit AND p.ord = c.ord WHERE c.port IS NULL) "
    "SELECT i.inst, i.unit, p.port FROM i JOIN p USING (unit) WHERE p.direction IN ('input', 'output') AND NOT EXISTS (SELECT 1 FROM g WHERE g.inst = i.inst AND g.port = p.port)"
)
def missing_ports(spark, sf):
    instances = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("inst"), F.col("c_nationkey").alias("unit"))
    o = F.col("o_orderkey")
    given = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("inst"), F.when(o % 3 > 0, F.col("o_orderpriority")).alias("port"), F.when(o % 3 == 0, o % 5).cast("int").alias("ord"))
    return symbols.missing_ports(instances, _ports(spark, sf), given).select("inst", "unit", "port")


@query(
    f"WITH p AS ({_PORTS_SQL}), c AS (SELECT o_orderkey AS inst, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS port, CAST(o_custkey % 30 AS INTEGER) AS target, o_custkey AS unit, o_orderstatus AS signal FROM orders), "
    "j AS (SELECT c.*, p.direction FROM c LEFT JOIN p ON p.unit = c.target AND p.port = c.port), "
    "e AS (SELECT unit, signal, inst, unnest(CASE WHEN port IS NULL THEN ['load'] WHEN direction = 'output' THEN ['drive'] WHEN direction = 'inout' THEN ['drive', 'load'] ELSE ['load'] END) AS effect FROM j) "
    "SELECT unit, signal, count(DISTINCT inst) AS n_drivers FROM e WHERE effect = 'drive' GROUP BY ALL HAVING n_drivers >= 2"
)
def multi_driven_signals(spark, sf):
    o = F.col("o_orderkey")
    connections = read_table(spark, sf, "orders").select(o.alias("inst"), F.when(o % 4 > 0, F.col("o_orderpriority")).alias("port"), (F.col("o_custkey") % 30).cast("int").alias("target"), F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("signal"))
    return symbols.multi_driven(symbols.port_effects(connections, _ports(spark, sf)).where("effect = 'drive'"))


@query("SELECT doc_id, CAST(nth AS INTEGER) AS nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1")
def repeated_declarations(spark, sf):
    rows = read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("name"))
    return symbols.repeats(rows, ["name"], ["doc_id"]).select("doc_id", "nth")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth = 1")
def first_definers(spark, sf):
    return symbols.first_definer(read_table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query(
    "WITH s AS (SELECT n_nationkey + 100 AS scope_id, [n_nationkey + 100, n_regionkey + 10, 1] AS ancestors FROM nation), "
    "y AS (SELECT s_nationkey + 100 AS scope_id, 'n' || (s_suppkey % 40) AS name, s_suppkey AS sym_id FROM supplier WHERE s_suppkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY scope_id, name ORDER BY s_suppkey) = 1 "
    "UNION ALL SELECT n_regionkey + 10, 'n' || (n_nationkey + 10), 10000 + n_nationkey FROM nation UNION ALL SELECT 1, 'n' || r_regionkey, 20000 + r_regionkey FROM region), "
    "f AS (SELECT c_custkey AS ref_id, 'n' || (c_custkey % 40) AS name, c_nationkey + 100 AS scope_id FROM customer), "
    "h AS (SELECT f.ref_id, y.sym_id, list_position(s.ancestors, y.scope_id) AS up FROM f JOIN s USING (scope_id) JOIN y ON y.name = f.name AND list_contains(s.ancestors, y.scope_id)) "
    "SELECT f.ref_id, f.name, (SELECT min_by(sym_id, up) FROM h WHERE h.ref_id = f.ref_id) AS sym_id FROM f"
)
def scope_resolution(spark, sf):
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    scopes = nation.select((n + 100).alias("scope_id"), F.array(n + 100, r + 10, F.lit(1)).alias("ancestors"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string")).alias("name")
    s = F.col("s_suppkey")
    own = read_table(spark, sf, "supplier").where(s % 3 == 0).select((F.col("s_nationkey") + 100).alias("scope_id"), name(s % 40), s.alias("sym_id"))
    own = symbols.first_definer(own, ["scope_id", "name"], ["sym_id"])
    table = own.unionByName(nation.select((r + 10).alias("scope_id"), name(n + 10), (n + 10000).cast("long").alias("sym_id")))
    table = table.unionByName(region.select(F.lit(1).alias("scope_id"), name(F.col("r_regionkey")), (F.col("r_regionkey") + 20000).cast("long").alias("sym_id")))
    c = F.col("c_custkey")
    references = read_table(spark, sf, "customer").select(c.alias("ref_id"), name(c % 40), (F.col("c_nationkey") + 100).alias("scope_id"))
    return symbols.resolved(references, scopes, table).select("ref_id", "name", "sym_id")


@query(
    "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey AS VARCHAR) WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS value, "
    "(CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey AS VARCHAR) WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END) <> r_name AS changed "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def parameter_overrides(spark, sf):
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    at = read_table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    defaults = at.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("value"))
    caller = at.where("n_nationkey % 2 = 0").select("s_suppkey", F.col("n_name").alias("value"))
    site = at.where("s_acctbal > 5000").select("s_suppkey", F.col("s_suppkey").cast("string").alias("value"))
    return symbols.overrides(defaults, caller, site, ["s_suppkey"])


@query(
    "WITH a AS (SELECT l_orderkey AS c, l_linestatus = 'O' AND l_linenumber = 3 AS is_default, CASE WHEN l_partkey % 29 > 0 THEN l_linenumber - 1 END AS value, CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END AS width FROM lineitem) "
    "SELECT c AS l_orderkey FROM a GROUP BY c HAVING NOT bool_or(is_default) AND NOT coalesce(bool_and(value IS NOT NULL OR is_default) AND count(DISTINCT value) = CAST(pow(2, max(width)) AS BIGINT) AND max(value) < pow(2, max(width)) AND min(value) >= 0, false)"
)
def uncovered_cases(spark, sf):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    arms = read_table(spark, sf, "lineitem").select(o, ((F.col("l_linestatus") == "O") & (n == 3)).alias("is_default"), F.when(F.col("l_partkey") % 29 > 0, n - 1).alias("value"), F.when(o % 2 == 0, 2).otherwise(1).alias("width"))
    return symbols.uncovered_cases(arms, ["l_orderkey"])


@query("SELECT l_orderkey, l_returnflag, count(DISTINCT l_linestatus) AS n_ops FROM lineitem GROUP BY ALL HAVING n_ops > 1")
def mixed_assignments(spark, sf):
    return symbols.mixed_operators(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linestatus")


#: Each order leads to its customer's next one; every seventh customer's last order leads back to the first.
_EDGES_SQL = (
    "SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_custkey % 7 = 0 THEN first(o_orderkey) OVER w END) AS dst "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE src <> dst"
)


def _edges(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    back = F.when(F.col("o_custkey") % 7 == 0, F.first("o_orderkey").over(by))
    e = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.coalesce(F.lead("o_orderkey").over(by), back).alias("dst"))
    return graph.unit_graph([("instance", e)])


@query(f"WITH RECURSIVE e AS ({_EDGES_SQL}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def unit_graph_closure(spark, sf):
    return graph.closure(_edges(spark, sf))


@query(
    f"WITH RECURSIVE e AS ({_EDGES_SQL}), r AS (SELECT o_orderkey AS root, o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) "
    "SELECT node, root FROM r WHERE node IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')"
)
def unit_dependents(spark, sf):
    """Which expensive urgent orders come before each order of low priority."""
    orders = read_table(spark, sf, "orders")
    roots = orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.col("o_orderkey").alias("root"))
    return graph.dependents(graph.reachable(_edges(spark, sf), roots), orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("node")))


@query(f"WITH e AS ({_EDGES_SQL}), x AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY node")
def unit_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(
    "WITH g AS (SELECT *, sum(CASE WHEN coalesce(o_orderkey - p > 400, false) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)) "
    "SELECT o_custkey, CAST(island AS BIGINT) AS island, count(*) AS n, CAST(max(length(o_orderpriority)) AS INTEGER) AS o_orderpriority_width FROM g GROUP BY ALL"
)
def column_groups(spark, sf):
    grouped = layout.islands(read_table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 400)
    sizes = grouped.groupBy("o_custkey", "island").agg(F.count("*").alias("n"))
    return sizes.join(layout.column_widths(grouped, ["o_custkey", "island"], ["o_orderpriority"]), ["o_custkey", "island"])


@query("SELECT n_nationkey, rtrim(rpad(n_name, CAST(max(length(n_name)) OVER (PARTITION BY n_regionkey) AS INTEGER), ' ') || ' ' || rpad(CAST(n_nationkey AS VARCHAR), CAST(max(length(CAST(n_nationkey AS VARCHAR))) OVER (PARTITION BY n_regionkey) AS INTEGER), ' ')) AS aligned FROM nation")
def aligned_columns(spark, sf):
    rows = read_table(spark, sf, "nation").withColumn("key", F.col("n_nationkey").cast("string"))
    return layout.aligned(rows, ["n_regionkey"], ["n_name", "key"]).select("n_nationkey", "aligned")


@query(f"SELECT path, CAST(line_no AS INTEGER) AS line_no, md5(CASE WHEN trim(raw, ' ' || chr(9)) = '' THEN '' ELSE repeat(' ', CAST(4 * (line_no % 3) AS INTEGER)) || trim(raw, ' ' || chr(9)) END) AS digest FROM ({_MARKED_SQL})")
def indented_lines(spark, sf):
    rows = _marked(spark, sf).withColumn("depth", F.col("line_no") % 3)
    return layout.indented(rows).select("path", "line_no", F.md5("indented").alias("digest"))


@query(
    f"WITH c AS (SELECT path, line_no, length(raw) AS size, unnest(regexp_extract_all(raw, '[^ ]*[ ]')) AS w, generate_subscripts(regexp_extract_all(raw, '[^ ]*[ ]'), 1) AS i FROM ({_LINES_SQL}) WHERE length(raw) > 100), "
    "d AS (SELECT *, sum(length(w)) OVER (PARTITION BY path, line_no ORDER BY i) AS p FROM c) "
    "SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(p AS INTEGER) AS break_at FROM d WHERE p < size "
    "QUALIFY row_number() OVER (PARTITION BY path, line_no ORDER BY greatest(p - 100, 0) + 2 * greatest(size - p - 100, 0), p DESC) = 1"
)
def wrap_points(spark, sf):
    return layout.break_points(_lines(spark, sf).where(F.length("raw") > 100), 100).select("path", "line_no", "break_at")


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL")
def json_attributes(spark, sf):
    return _events(spark, sf).groupBy("event_type", "k").agg(F.count("*").alias("n"))


_WIDTH_SQL = "CASE WHEN r = '' THEN 1 WHEN instr(r, ':') = 0 THEN TRY_CAST(r AS BIGINT) + 1 ELSE abs(TRY_CAST(split_part(r, ':', 1) AS BIGINT) - TRY_CAST(split_part(r, ':', 2) AS BIGINT)) + 1 END"


@query(
    "WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_size AS VARCHAR) || ':0' ELSE 'W-1:0' END AS r FROM part), "
    f"w AS (SELECT p_partkey, CASE WHEN regexp_matches(r, '[A-Z]') THEN NULL ELSE CAST({_WIDTH_SQL} AS BIGINT) END AS left_width, CAST(length(bin(p_size)) AS BIGINT) AS right_width FROM p) "
    "SELECT p_partkey, left_width, right_width FROM w WHERE right_width > left_width"
)
def width_truncations(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, "").when(k % 4 == 1, size).when(k % 4 == 2, F.concat(F.lit("["), size, F.lit(" : 0]"))).otherwise("W-1:0")
    rows = read_table(spark, sf, "part").select("p_partkey", widths.width_of_range(text).alias("left_width"), widths.width_of_literal(size).alias("right_width"))
    return rows.where("right_width > left_width")


_NEW_SQL = "SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN replace(text, 'th', 'TH') ELSE text END AS text FROM documents WHERE doc_id % 11 > 0 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 13 = 0"


def _snapshots(spark, sf):
    old = read_table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    edited = F.when(F.col("path") % 9 == 0, F.replace("text", F.lit("th"), F.lit("TH"))).otherwise(F.col("text")).alias("text")
    new = old.where("path % 11 > 0").select("path", edited).unionByName(old.where("path % 13 = 0").select((F.col("path") + 1000000).alias("path"), "text"))
    return old, new


@query(f"WITH n AS ({_NEW_SQL}), o AS (SELECT doc_id AS path, text FROM documents) SELECT path, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' ELSE 'edited' END AS change FROM o FULL JOIN n USING (path) WHERE o.text IS DISTINCT FROM n.text")
def changed_files(spark, sf):
    return changes.changed_files(*_snapshots(spark, sf))


@query(
    f"WITH o AS ({_LINES_SQL}), n AS (SELECT path, line_no, CASE WHEN path % 3 = 0 AND line_no % 4 = 1 THEN 'x' || raw ELSE raw END AS raw FROM o), "
    "d AS (SELECT path, min(line_no) AS first, max(line_no) + 1 AS last FROM o JOIN n USING (path, line_no) WHERE o.raw <> n.raw GROUP BY path) "
    "SELECT path, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS old_end, CAST(last AS BIGINT) AS new_end FROM d"
)
def damaged_ranges(spark, sf):
    old = _lines(spark, sf)
    new = old.withColumn("raw", F.when((F.col("path") % 3 == 0) & (F.col("line_no") % 4 == 1), F.concat(F.lit("x"), "raw")).otherwise(F.col("raw")))
    out = changes.damaged_range(old, new)
    return out.select("path", *(F.col(c).cast("long").alias(c) for c in ("first", "old_end", "new_end")))


@query("SELECT DISTINCT p_partkey, p_name, p_type FROM part JOIN (VALUES ('a', 'TYPE1'), ('ed', 'TYPE2'), ('n', 'TYPE3'), ('t', 'TYPE4'), ('1', 'TYPE5')) s(suffix, meaning) ON suffix(p_name, s.suffix) AND p_type <> meaning")
def suffix_conflicts(spark, sf):
    table = spark.createDataFrame([("a", "TYPE1"), ("ed", "TYPE2"), ("n", "TYPE3"), ("t", "TYPE4"), ("1", "TYPE5")], "suffix string, meaning string")
    rows = read_table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), "p_type")
    return rules.suffix_conflicts(rows, table, "p_type").withColumnRenamed("name", "p_name")
