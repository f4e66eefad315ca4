"""Queries over derived relations of units, typed ports, constants and settings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants, widths
from ..operators import graph, ports, settings, symbols
from ..sources.tables import read_table
from .queries import _LINES_SQL, _PORTS_SQL, _lines, _ports, query


@query(
    "SELECT unit, param, value FROM (SELECT l_suppkey AS unit, l_shipdate_month AS param, l_orderkey AS value, row_number() OVER (PARTITION BY l_suppkey, l_shipdate_month ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_orderkey * 10 + l_linenumber) AS nth "
    "FROM (SELECT *, month(l_shipdate) AS l_shipdate_month FROM lineitem)) WHERE nth = 1"
)
def parameter_defaults(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.month("l_shipdate").cast("long").alias("param"), F.col("l_orderkey").alias("value"), F.when(F.col("l_returnflag") == "N", "header").otherwise("body").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return ports.parameter_defaults(rows)


@query(
    "WITH h AS (SELECT c_custkey AS unit, c_nationkey AS port, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS direction, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 16 END AS width, CAST(NULL AS VARCHAR) AS net_type FROM customer WHERE c_custkey % 5 > 0), "
    "b AS (SELECT c_custkey AS unit, c_nationkey AS port, 'body' AS direction, c_custkey % 7 AS width, CASE WHEN c_custkey % 2 = 0 THEN 'tri' END AS net_type FROM customer WHERE c_custkey % 4 > 0) "
    "SELECT unit, port, coalesce(h.direction, b.direction) AS direction, coalesce(h.width, b.width) AS width, coalesce(h.net_type, b.net_type) AS net_type FROM h FULL JOIN b USING (unit, port)"
)
def port_declarations(spark, sf):
    c = F.col("c_custkey")
    base = read_table(spark, sf, "customer").select(c.alias("unit"), F.col("c_nationkey").alias("port"), "c_acctbal", "c_mktsegment", c.alias("k"))
    header = base.where("k % 5 > 0").select("unit", "port", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("direction"), F.when(F.col("k") % 3 == 0, F.col("k") % 16).alias("width"), F.lit(None).cast("string").alias("net_type"))
    body = base.where("k % 4 > 0").select("unit", "port", F.lit("body").alias("direction"), (F.col("k") % 7).alias("width"), F.when(F.col("k") % 2 == 0, "tri").alias("net_type"))
    return ports.port_declarations(header, body)


@query(
    "WITH i AS (SELECT conv_id AS inst, min(turn) AS unit, list(role ORDER BY turn) AS placed FROM conversations GROUP BY conv_id), n AS (SELECT conv_id AS inst, role AS port, md5(max(text)) AS signal FROM conversations GROUP BY ALL) "
    "SELECT inst, port, CAST(NULL AS INTEGER) AS ord, signal FROM n UNION ALL SELECT inst, NULL, CAST(generate_subscripts(placed, 1) - 1 AS INTEGER), unnest(placed) FROM i"
)
def connection_rows(spark, sf):
    turns = read_table(spark, sf, "conversations")
    named = turns.groupBy("conv_id", "role").agg(F.md5(F.max("text")).alias("signal")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "signal"))).alias("named"))
    placed = turns.groupBy("conv_id").agg(F.min("turn").alias("unit"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("placed"))
    return ports.connections(named.join(placed, "conv_id").withColumnRenamed("conv_id", "inst")).select("inst", "port", "ord", "signal")


_DECLARED_SQL = "d AS (SELECT p_size AS unit, p_partkey AS name, p_partkey % 5 AS kind, p_partkey % 9 AS low FROM part), v AS (SELECT DISTINCT p_size AS unit, p_size * 2 AS w FROM part WHERE p_size % 10 > 0)"
_WIDTHS_SQL = f"{_DECLARED_SQL}, sw AS (SELECT d.unit, d.name, CASE kind WHEN 0 THEN 1 WHEN 1 THEN low + 1 WHEN 2 THEN abs(low - 2) + 1 WHEN 3 THEN abs(w - 1 - 0) + 1 ELSE w + 1 END AS width FROM d LEFT JOIN v USING (unit))"


def _declared(spark, sf):
    k = F.col("p_partkey") % 5
    low = (F.col("p_partkey") % 9).cast("string")
    text = F.when(k == 0, "").when(k == 1, low).when(k == 2, F.concat(F.lit("["), low, F.lit(" : 2]"))).when(k == 3, "W-1:0").otherwise("W")
    return read_table(spark, sf, "part").select(F.col("p_size").alias("unit"), F.col("p_partkey").alias("name"), text.alias("width_expr"))


def _values(spark, sf):
    return read_table(spark, sf, "part").where("p_size % 10 > 0").select(F.col("p_size").alias("unit"), F.lit("W").alias("param"), (F.col("p_size") * 2).cast("string").alias("value")).distinct()


@query(f"WITH {_WIDTHS_SQL} SELECT unit, name, CAST(width AS BIGINT) AS width FROM sw")
def symbol_widths(spark, sf):
    return ports.symbol_widths(_declared(spark, sf), _values(spark, sf))


@query(
    f"WITH {_WIDTHS_SQL}, c AS (SELECT l_orderkey * 10 + l_linenumber AS inst, p_size AS unit, l_partkey AS signal, l_suppkey % 40 AS target, l_linenumber AS port FROM lineitem JOIN part ON p_partkey = l_partkey), "
    "p AS (SELECT n_nationkey AS target, x AS port, n_nationkey % 5 + x AS width FROM nation, (SELECT unnest(range(1, 8)) AS x)) "
    "SELECT inst, c.port, c.signal, CAST(sw.width AS BIGINT) AS signal_width, CAST(p.width AS BIGINT) AS port_width FROM c JOIN p USING (target, port) JOIN sw ON sw.unit = c.unit AND sw.name = c.signal WHERE sw.width > p.width"
)
def wide_port_connections(spark, sf):
    l = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    given = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inst"), F.col("p_size").alias("unit"), F.col("l_partkey").alias("signal"), (F.col("l_suppkey") % 40).alias("target"), F.col("l_linenumber").alias("port"))
    declared = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("port")).withColumn("width", (F.col("target") % 5 + F.col("port")).cast("long"))
    signals = ports.symbol_widths(_declared(spark, sf), _values(spark, sf)).withColumnRenamed("name", "signal")
    return ports.wide_connections(given, declared, signals)


@query(
    f"WITH {_DECLARED_SQL}, i AS (SELECT s_suppkey AS inst, s_nationkey + 1 AS unit, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 50 END AS given FROM supplier) "
    "SELECT inst, name, CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN low + 1 WHEN 2 THEN abs(low - 2) + 1 WHEN 3 THEN abs(x - 1) + 1 ELSE x + 1 END AS BIGINT) AS width "
    "FROM (SELECT i.inst, d.*, CASE WHEN w IS NULL THEN NULL ELSE coalesce(given, w) END AS x FROM i JOIN d USING (unit) LEFT JOIN v USING (unit))"
)
def instance_widths(spark, sf):
    s = F.col("s_suppkey")
    instances = read_table(spark, sf, "supplier").select(s.alias("inst"), (F.col("s_nationkey") + 1).alias("unit"))
    given = read_table(spark, sf, "supplier").where(s % 3 == 0).select(s.alias("inst"), F.lit("W").alias("param"), (s % 50).cast("string").alias("value"))
    return ports.instance_widths(instances, _declared(spark, sf), _values(spark, sf), given)


@query(
    "WITH p AS (SELECT n_nationkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'W-1:0' ELSE '7:0' END AS width_expr FROM nation) "
    "SELECT o_orderkey AS inst, 'p' AS port, CASE WHEN o_orderkey % 3 = 0 THEN '8''hff' ELSE o_orderpriority END AS signal FROM orders JOIN p ON target = o_custkey % 30 "
    "WHERE regexp_matches(width_expr, '[A-Za-z]') AND (o_orderkey % 3 = 0 OR regexp_matches(o_orderpriority, '^[0-9]'))"
)
def dead_literals(spark, sf):
    declared = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("target"), F.lit("p").alias("port"), F.when(F.col("n_nationkey") % 2 == 0, "W-1:0").otherwise("7:0").alias("width_expr"))
    given = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("inst"), (F.col("o_custkey") % 30).alias("target"), F.lit("p").alias("port"), F.when(F.col("o_orderkey") % 3 == 0, "8'hff").otherwise(F.col("o_orderpriority")).alias("signal"))
    return ports.dead_literals(given, declared)


@query(
    f"WITH {_WIDTHS_SQL}, s AS (SELECT l_orderkey * 10 + l_linenumber AS id, p_size AS unit, l_partkey AS signal, l_linenumber + 5 AS high, l_linenumber - 2 AS low FROM lineitem JOIN part ON p_partkey = l_partkey) "
    "SELECT id, high, low FROM s JOIN sw ON sw.unit = s.unit AND sw.name = s.signal WHERE high >= width OR low < 0 OR low >= width OR high < 0"
)
def select_bounds(spark, sf):
    l = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    selects = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("p_size").alias("unit"), F.col("l_partkey").alias("signal"), (F.col("l_linenumber") + 5).alias("high"), (F.col("l_linenumber") - 2).alias("low"))
    return ports.out_of_bounds(selects, ports.symbol_widths(_declared(spark, sf), _values(spark, sf)).withColumnRenamed("name", "signal")).select("id", "high", "low")


@query(f"WITH p AS ({_PORTS_SQL}) SELECT unit, port FROM p WHERE direction = 'inout' AND unit % 3 > 0")
def inout_not_tri(spark, sf):
    return ports.inout_not_tri(_ports(spark, sf).withColumn("net_type", F.when(F.col("unit") % 3 == 0, "tri"))).select("unit", "port")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND o_orderkey % 3 < 2")
def blocking_in_clocked(spark, sf):
    o = F.col("o_orderkey") % 3
    blocks = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("block"), F.when(o == 0, "posedge clk or negedge rst").when(o == 1, " edge c").when(F.col("o_orderkey") % 2 == 0, "knowledge").alias("control"))
    assigned = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), "l_linenumber", F.when(F.col("l_linestatus") == "O", "=").otherwise("<=").alias("op"))
    return ports.blocking_in_clocked(assigned, blocks).select(F.col("block").alias("l_orderkey"), "l_linenumber")


@query(
    "WITH u AS (SELECT 'src/Supplier#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0') || '.v' AS path, 'supplier#' || lpad(CAST(c_custkey % 7 * 50 AS VARCHAR), 9, '0') AS unit, c_custkey FROM customer) "
    "SELECT path, unit, c_custkey FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.path = u.path AND lower(replace(replace(o.path, 'src/', ''), '.v', '')) = lower(o.unit))"
)
def misnamed_units(spark, sf):
    name = lambda n: F.lpad(n.cast("string"), 9, "0")
    c = F.col("c_custkey")
    units = read_table(spark, sf, "customer").select(F.concat(F.lit("src/Supplier#"), name(c % 200), F.lit(".v")).alias("path"), F.concat(F.lit("supplier#"), name(c % 7 * 50)).alias("unit"), c)
    return ports.misnamed_units(units).select("path", "unit", "c_custkey")


_ASSIGNED_SQL = "a AS (SELECT CAST(l_suppkey AS VARCHAR) AS unit, CASE WHEN l_linenumber % 3 = 0 THEN 'x[1]' ELSE 's' || (l_partkey % 20) END AS target, l_orderkey * 10 + l_linenumber AS line FROM lineitem)"


def _assigned(spark, sf):
    return read_table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("unit"), F.when(F.col("l_linenumber") % 3 == 0, "x[1]").otherwise(F.concat(F.lit("s"), (F.col("l_partkey") % 20).cast("string"))).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))


@query(f"WITH {_ASSIGNED_SQL} SELECT unit, target AS signal, unit || ':assign#' || nth AS ref FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY line, target) AS nth FROM a) WHERE target <> 'x[1]'")
def assign_drivers(spark, sf):
    return ports.assign_drivers(_assigned(spark, sf))


_LINKS_SQL = (
    "own AS (SELECT s_suppkey AS unit, s_suppkey % 4 AS signal, 'assign ' || s_suppkey AS ref FROM supplier WHERE s_suppkey % 3 = 0), "
    "links AS (SELECT o_custkey AS unit, o_orderkey % 4 AS signal, o_orderkey AS inst, o_custkey + o_orderkey % 5 + 1 AS target, o_orderkey % 3 AS port FROM orders WHERE o_orderkey % 4 = 0), "
    "ports AS (SELECT s_suppkey AS unit, x AS port FROM supplier, (SELECT unnest(range(0, 3)) AS x))"
)


@query(
    f"WITH RECURSIVE {_LINKS_SQL}, r AS (SELECT unit, port, unit AS at, port AS signal FROM ports UNION SELECT r.unit, r.port, l.target, l.port FROM r JOIN links l ON l.unit = r.at AND l.signal = r.signal JOIN ports p ON p.unit = l.target AND p.port = l.port) "
    "SELECT r.unit, r.port, ref FROM r JOIN own ON own.unit = r.at AND own.signal = r.signal UNION "
    "SELECT r.unit, r.port, 'inst:' || l.inst FROM r JOIN links l ON l.unit = r.at AND l.signal = r.signal WHERE NOT EXISTS (SELECT 1 FROM ports p WHERE p.unit = l.target AND p.port = l.port)"
)
def port_drivers(spark, sf):
    s, o = F.col("s_suppkey"), F.col("o_orderkey")
    supplier = read_table(spark, sf, "supplier")
    own = supplier.where(s % 3 == 0).select(s.alias("unit"), (s % 4).alias("signal"), F.concat(F.lit("assign "), s.cast("string")).alias("ref"))
    links = read_table(spark, sf, "orders").where(o % 4 == 0).select(F.col("o_custkey").alias("unit"), (o % 4).alias("signal"), o.alias("inst"), (F.col("o_custkey") + o % 5 + 1).alias("target"), (o % 3).alias("port"))
    declared = supplier.select(s.alias("unit"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("port"))
    return ports.port_drivers(own, links, declared).select("unit", "port", "ref")


_BIND_SQL = "b AS (SELECT o_orderkey AS bind_id, o_orderstatus AS type, o_orderpriority AS role, o_custkey % 2000 AS inst, o_orderkey % 9 AS port FROM orders), n AS (SELECT c_custkey AS inst, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS of_type, CASE WHEN c_custkey % 4 > 0 THEN '1-URGENT' ELSE '5-LOW' END AS of_role FROM customer WHERE c_custkey % 10 > 0)"


def _bindings(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("bind_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("role"), (F.col("o_custkey") % 2000).alias("inst"), (F.col("o_orderkey") % 9).alias("port"))


@query(
    f"WITH {_BIND_SQL}, p AS (SELECT DISTINCT o_orderstatus AS type, o_orderpriority AS role, o_orderkey % 7 AS port FROM orders) "
    "SELECT bind_id, code FROM (SELECT bind_id, CASE WHEN of_type IS NULL THEN 'TP010' WHEN p.port IS NULL THEN 'TP003' WHEN of_type <> b.type THEN 'TP011' WHEN of_role <> b.role THEN 'TP012' END AS code "
    "FROM b LEFT JOIN n ON n.inst = b.inst LEFT JOIN p ON p.type = b.type AND p.role = b.role AND p.port = b.port) WHERE code IS NOT NULL"
)
def binding_errors(spark, sf):
    b = _bindings(spark, sf)
    role_ports = b.select("type", "role", (F.col("bind_id") % 7).alias("port")).distinct()
    c = F.col("c_custkey")
    kind = F.when(c % 3 == 0, "F").when(c % 3 == 1, "O").otherwise("P")
    instances = read_table(spark, sf, "customer").where(c % 10 > 0).select(c.alias("inst"), kind.alias("of_type"), F.when(c % 4 > 0, "1-URGENT").otherwise("5-LOW").alias("of_role"))
    return ports.binding_errors(b, role_ports, instances)


@query(f"WITH {_BIND_SQL} SELECT inst, count(DISTINCT bind_id) AS n_bindings FROM b GROUP BY inst HAVING n_bindings >= 2")
def multiple_bindings(spark, sf):
    return ports.multiple_bindings(_bindings(spark, sf))


_ROLES_SQL = "roles AS (SELECT c_nationkey AS type, c_custkey AS role, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 25 WHEN 2 THEN c_custkey + 1 END AS inverts FROM customer)"


@query(
    f"WITH {_ROLES_SQL} SELECT type, role, inverts, code FROM (SELECT *, CASE WHEN inverts = role THEN 'TP006' WHEN NOT EXISTS (SELECT 1 FROM roles o WHERE o.type = roles.type AND o.role = roles.inverts) THEN 'TP002' END AS code FROM roles WHERE inverts IS NOT NULL) WHERE code IS NOT NULL"
)
def invert_errors(spark, sf):
    c = F.col("c_custkey")
    inverts = F.when(c % 4 == 0, c).when(c % 4 == 1, c + 25).when(c % 4 == 2, c + 1)
    return ports.invert_errors(read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("type"), c.alias("role"), inverts.alias("inverts")))


@query(
    "WITH RECURSIVE own AS (SELECT n_regionkey AS t, n_nationkey AS r, 'p' || x AS port, CASE (n_nationkey + x) % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'output' ELSE 'inout' END AS direction FROM nation, (SELECT unnest(range(0, 2)) AS x)), "
    "used AS (SELECT a.n_regionkey AS t, a.n_nationkey AS r, 'u' || b.n_nationkey AS name, b.n_regionkey AS t2, b.n_nationkey AS r2, b.n_nationkey % 2 = 0 AS inverted FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey * 2 + 1) % 25, (a.n_nationkey + 7) % 25) WHERE a.n_nationkey % 3 > 0), "
    "w AS (SELECT n_regionkey AS type, n_nationkey AS role, n_regionkey AS t, n_nationkey AS r, '' AS prefix, false AS turned, [n_regionkey || '.' || n_nationkey] AS chain FROM nation UNION ALL "
    "SELECT w.type, w.role, u.t2, u.r2, prefix || u.name || '_', turned <> inverted, list_append(chain, u.t2 || '.' || u.r2) FROM w JOIN used u ON u.t = w.t AND u.r = w.r WHERE NOT list_contains(chain, u.t2 || '.' || u.r2)) "
    "SELECT type, role, prefix || port AS port, CASE WHEN turned AND direction = 'input' THEN 'output' WHEN turned AND direction = 'output' THEN 'input' ELSE direction END AS direction, array_to_string(chain, '>') AS chain FROM w JOIN own ON own.t = w.t AND own.r = w.r"
)
def expanded_roles(spark, sf):
    n = read_table(spark, sf, "nation").select(F.col("n_regionkey").alias("type"), F.col("n_nationkey").alias("role"))
    k = F.col("role")
    own = n.select("type", "role", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("x"))
    turn = (k + F.col("x")) % 3
    own = own.select("type", "role", F.concat(F.lit("p"), F.col("x").cast("string")).alias("port"), F.when(turn == 0, "input").when(turn == 1, "output").otherwise("inout").alias("direction"))
    uses = n.where(k % 3 > 0).select("type", "role", F.explode(F.array_distinct(F.array((k * 2 + 1) % 25, (k + 7) % 25))).alias("used_role"))
    named = n.select(F.col("type").alias("used_type"), F.col("role").alias("used_role"))
    used = uses.join(named, "used_role").select("type", "role", F.concat(F.lit("u"), F.col("used_role").cast("string")).alias("name"), "used_type", "used_role", (F.col("used_role") % 2 == 0).alias("inverted"))
    return ports.expand_roles(n, own, used)


@query(
    "WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_orderkey - 900) * power(2, l_linenumber * 7)::BIGINT AS a, l_partkey - 100 AS b FROM lineitem), y AS (SELECT *, a::HUGEINT AS ha, b::HUGEINT AS hb FROM x) "
    "SELECT k, n, TRY_CAST(ha + hb AS BIGINT) AS added, TRY_CAST(ha - hb AS BIGINT) AS taken, TRY_CAST(ha * hb AS BIGINT) AS product, CASE WHEN b <> 0 THEN TRY_CAST(ha // hb AS BIGINT) END AS quotient, CASE WHEN b <> 0 THEN TRY_CAST(ha % hb AS BIGINT) END AS rest, "
    "a & b AS both, a | b AS one, xor(a, b) AS either, CAST(a < b AS BIGINT) AS less, ~a AS flipped, -a AS negative, CAST(a = 0 AS BIGINT) AS nought, "
    "CASE WHEN b <= 0 THEN CASE WHEN -b >= 63 THEN CASE WHEN a < 0 THEN -1 ELSE 0 END ELSE a >> CAST(-b AS INTEGER) END WHEN a = 0 THEN 0 WHEN b < 63 THEN TRY_CAST(ha * power(2, b)::HUGEINT AS BIGINT) END AS shifted FROM y"
)
def constant_arithmetic(spark, sf):
    # out of 64 bits a is unknown, and so is what follows from it
    a = F.try_multiply(F.col("l_orderkey") - 900, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber") * 7)).alias("a")
    x = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), a, (F.col("l_partkey") - 100).alias("b"))
    two = {"added": "+", "taken": "-", "product": "*", "quotient": "/", "rest": "%", "both": "&", "one": "|", "either": "^", "less": "<"}
    one = {"flipped": "~", "negative": "-", "nought": "!"}
    c = F.col
    return x.select("k", "n", *(constants.binary(o, c("a"), c("b")).alias(k) for k, o in two.items()), *(constants.unary(o, c("a")).alias(k) for k, o in one.items()), constants.shift(c("a"), c("b")).alias("shifted"))


@query(
    "WITH t AS (SELECT p_partkey AS k, p_size AS v FROM part) SELECT k, CAST(v AS BIGINT) AS hex, CAST(v AS BIGINT) AS octal, CAST(v AS BIGINT) AS decimal, CAST(v + 64 AS BIGINT) AS packed, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(v AS BIGINT) END AS based, CASE WHEN k % 2 = 0 THEN 8 END::BIGINT AS width FROM t"
)
def constant_texts(spark, sf):
    """The same number written in several ways and read back."""
    v, k = F.col("p_size"), F.col("p_partkey")
    hexa, octal = F.hex(v), F.conv(v.cast("string"), 10, 8)
    sized = F.concat(F.when(k % 2 == 0, "8").otherwise(""), F.lit("'h"), F.lit("0_"), F.when(k % 3 == 0, F.concat(hexa, F.lit("x"))).otherwise(hexa))
    both = constants.sized_constant(sized)
    letters = F.concat(F.lit("'\\x"), F.hex(v + 64), F.lit("'"))
    return read_table(spark, sf, "part").select(
        k.alias("k"), constants.integer(F.concat(F.lit("0X"), hexa, F.lit("uL"))).alias("hex"), constants.integer(F.concat(F.lit("0"), octal)).alias("octal"), constants.integer(F.concat(v.cast("string"), F.lit("LL"))).alias("decimal"),
        constants.character(letters).alias("packed"), both["value"].alias("based"), both["width"].alias("width"),
    )


@query(
    "WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN '+' WHEN 2 THEN '==' WHEN 3 THEN '<<' WHEN 4 THEN '??' WHEN 5 THEN '|' ELSE '&&' END AS op, CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 32 END::BIGINT AS a, CAST(l_suppkey % 16 AS BIGINT) AS b FROM lineitem) "
    "SELECT k, n, CASE WHEN op IN ('==', '&&') THEN 1 WHEN op = '<<' THEN a WHEN op = '??' THEN NULL WHEN a IS NOT NULL THEN greatest(a, b) END::BIGINT AS combined, a + b + 1 AS listed, 3 * b AS repeated, CASE WHEN a IS NOT NULL THEN greatest(a, b) END AS chosen, CAST(CASE n WHEN 1 THEN 1 WHEN 2 THEN b + 1 WHEN 3 THEN b WHEN 4 THEN b END AS BIGINT) AS selected FROM e"
)
def expression_widths(spark, sf):
    n, b = F.col("l_linenumber"), (F.col("l_suppkey") % 16).cast("long")
    op = F.when(n == 1, "+").when(n == 2, "==").when(n == 3, "<<").when(n == 4, "??").when(n == 5, "|").otherwise("&&")
    a = F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey") % 32).cast("long")
    text = b.cast("string")
    select = F.when(n == 1, F.concat(F.lit("["), text, F.lit("]"))).when(n == 2, F.concat(F.lit("["), text, F.lit(":0]"))).when(n == 3, F.concat(F.lit("[i +: "), text, F.lit("]"))).when(n == 4, F.concat(F.lit("[9 -: "), text, F.lit("]"))).otherwise("[x:y]")
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), widths.width_of_binary(op, a, b).alias("combined"), widths.width_of_concat(F.array(a, b, F.lit(1).cast("long"))).alias("listed"),
        widths.width_of_repeat(F.lit(3), b).alias("repeated"), widths.width_of_choice(a, b).alias("chosen"), widths.width_of_select(select).alias("selected"),
    )


_SETTINGS_SQL = (
    "s AS (SELECT CAST(event_id % 3 AS INTEGER) AS layer, user_id AS lang, event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.a' WHEN 2 THEN '.b' ELSE '.b.c' END AS path, max(event_id) AS value FROM events GROUP BY ALL)"
)


@query(
    f"WITH {_SETTINGS_SQL} SELECT lang, path, layer, value FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.lang = s.lang AND o.layer > s.layer AND (o.path = s.path OR starts_with(o.path, s.path || '.') OR starts_with(s.path, o.path || '.')))"
)
def merged_settings(spark, sf):
    e, k = read_table(spark, sf, "events"), F.col("event_id")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, ".a").when(k % 4 == 2, ".b").otherwise(".b.c")
    rows = e.groupBy((k % 3).cast("int").alias("layer"), F.col("user_id").alias("lang"), F.concat("event_type", tail).alias("path")).agg(F.max("event_id").alias("value"))
    return settings.merged(rows, ["lang"]).select("lang", "path", "layer", "value")


@query(
    "WITH e AS (SELECT user_id AS lang, event_type AS name, event_id % 3 AS layer, event_id AS ord FROM events), f AS (SELECT lang, name, max_by(ord, layer * 1000000000 + ord) AS value, min(layer * 1000000000 + ord) AS first FROM e GROUP BY ALL) "
    "SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY first) - 1 AS INTEGER) AS ord, name, value FROM f"
)
def settings_by_name(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("lang"), F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("layer"), F.col("event_id").alias("ord"), F.col("event_id").alias("value"))
    return settings.merged_by_name(e, ["lang"])


@query(
    f"WITH l AS (SELECT path, line_no, unnest(regexp_extract_all(raw, '\\bthe ([a-z]+)', 1)) AS w FROM ({_LINES_SQL})) "
    "SELECT name, path, CAST(line_no AS INTEGER) AS line_no FROM (SELECT w AS name, path, line_no, row_number() OVER (PARTITION BY w ORDER BY path, line_no) AS nth FROM l) WHERE nth = 1"
)
def keyword_index(spark, sf):
    """The first place of each name that a keyword declares."""
    found = _lines(spark, sf).select("path", "line_no", F.explode(F.regexp_extract_all("raw", F.lit(r"\bthe ([a-z]+)"), F.lit(1))).alias("name"))
    return symbols.first_definer(found, ["name"], ["path", "line_no"]).select("name", "path", "line_no")


@query(
    "WITH f AS (SELECT page_id, 'dir' || page_id % 5 AS dir, 'dir' || page_id % 5 || '/f' || page_id % 40 AS file FROM pages), r AS (SELECT page_id, dir, 'f' || page_id % 60 AS name, page_id % 2 = 0 AS relative FROM f), "
    "d AS (SELECT page_id, CASE WHEN relative THEN [dir, 'dir1', 'dir2'] ELSE ['dir1', 'dir2', dir] END AS dirs, name FROM r), x AS (SELECT page_id, unnest(dirs) || '/' || name AS file, generate_subscripts(dirs, 1) AS i FROM d) "
    "SELECT page_id, min_by(file, i) AS file FROM x WHERE file IN (SELECT file FROM f) GROUP BY page_id"
)
def resolved_includes(spark, sf):
    """Names brought to the first existing file of their search order."""
    p = F.col("page_id")
    folder = lambda n: F.concat(F.lit("dir"), n.cast("string"))
    pages = read_table(spark, sf, "pages")
    files = pages.select(F.concat(folder(p % 5), F.lit("/f"), (p % 40).cast("string")).alias("file")).distinct()
    wanted = pages.select(p, folder(p % 5).alias("dir"), F.concat(F.lit("f"), (p % 60).cast("string")).alias("name"), (p % 2 == 0).alias("relative"))
    return graph.resolved_names(wanted, files, ["dir1", "dir2"], "page_id")


@query(
    "WITH e AS (SELECT page_id AS src, CAST(unnest(regexp_extract_all(html, 'f([0-9]+)', 1)) AS VARCHAR) AS t FROM (SELECT page_id, replace(url, '/', '/f') AS html FROM pages)) "
    "SELECT DISTINCT src, TRY_CAST(t AS BIGINT) % 100 AS dst FROM e WHERE src <> TRY_CAST(t AS BIGINT) % 100"
)
def include_edges(spark, sf):
    pages = read_table(spark, sf, "pages")
    found = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all(F.replace("url", F.lit("/"), F.lit("/f")), F.lit("f([0-9]+)"), F.lit(1))).alias("t"))
    return graph.unit_graph([("include", found.select("src", (F.col("t").try_cast("long") % 100).alias("dst")))]).select("src", "dst")
