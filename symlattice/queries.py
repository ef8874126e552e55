"""Registered queries over the derived interface graphs, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.functions.filters import compile_filter
from symlattice.functions.hashing import combine, fnv1a, hex32, mix32
from symlattice.operators import diff
from symlattice.operators.fixpoint import chains, components
from symlattice.plans.compare import Comparison, colours, reachable
from symlattice.plans.pieces import pieces
from symlattice.session import table
from symlattice.sources.tables import KIND_RANGE, KINDS, VERSION_RANGE, TableGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sym(v: int) -> str:
    gone = "c_custkey % 97 = 5" if v == 0 else "c_custkey % 89 = 7"
    change = "CASE WHEN c_custkey % 41 = 0 THEN 1 ELSE 0 END" if v else "0"
    bind = "CASE WHEN c_custkey % 53 = 0 THEN 'WEAK' ELSE 'GLOBAL' END" if v else "'GLOBAL'"
    return f"sym{v} AS (SELECT {14 * KIND_RANGE + v * VERSION_RANGE} + c_custkey AS id, c_name AS name, {bind} AS binding, (c_custkey % 65536) * 40503 + c_custkey // 65536 + {change} AS crc, {13 * KIND_RANGE + v * VERSION_RANGE} + c_custkey AS type_id FROM customer WHERE NOT {gone})"


def _par(v: int) -> str:
    return f"par{v} AS (SELECT o_custkey AS cust, {13 * KIND_RANGE + v * VERSION_RANGE} + o_custkey AS function_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey AS ord, {2 * KIND_RANGE + v * VERSION_RANGE} + o_orderkey AS type_id FROM orders{" WHERE o_orderkey % 73 <> 3" if v else ""})"


def _st(v: int) -> str:
    return f"st{v} AS (SELECT {11 * KIND_RANGE + v * VERSION_RANGE} + o_orderkey AS id, 'order_' || o_orderkey AS name, CASE WHEN o_orderkey % {61 if v == 0 else 67} <> 0 THEN 8 * coalesce(n, 0) END AS bytesize FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"


def _mem(v: int) -> str:
    moved = "CASE WHEN l_orderkey % 31 = 0 THEN 64 ELSE 0 END" if v else "0"
    return (
        f"mem{v} AS (SELECT {10 * KIND_RANGE + v * VERSION_RANGE} + l_orderkey * 64 + pos AS id, {11 * KIND_RANGE + v * VERSION_RANGE} + l_orderkey AS struct_id, l_orderkey AS ord, pos, 'l_' || l_linenumber AS name, (l_linenumber - 1) * 64 + {moved} AS off, {4 * KIND_RANGE + v * VERSION_RANGE} + l_partkey AS type_id, "
        "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS pos FROM lineitem))"
    )


def _prim(v: int) -> str:
    return (
        f"kinds{v} AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS rank FROM (SELECT DISTINCT p_type FROM part)), "
        f"prim{v} AS (SELECT {6 * KIND_RANGE + v * VERSION_RANGE} + rank AS id, p_type AS name, CASE WHEN rank = 1 THEN {4 + 4 * v} ELSE 4 END AS bytesize FROM kinds{v} UNION ALL SELECT {6 * KIND_RANGE + v * VERSION_RANGE} + 1000 + n_nationkey, 'nation ' || n_name, 8 FROM nation), "
        f"td{v} AS (SELECT {4 * KIND_RANGE + v * VERSION_RANGE} + p_partkey AS id, 'part_' || p_partkey AS name, {6 * KIND_RANGE + v * VERSION_RANGE} + rank AS referred FROM part JOIN kinds{v} USING (p_type))"
    )


def _graph(v: int) -> str:
    i, f, p = (k * KIND_RANGE + v * VERSION_RANGE for k in (15, 13, 2))
    return ", ".join([_sym(v), _par(v), _st(v), _mem(v), _prim(v)]) + (
        f", node{v} AS (SELECT id, 'elf_symbol' AS kind, name || '|' || binding || '|' || crc AS local, '' AS tag FROM sym{v} UNION ALL SELECT {f} + c_custkey, 'function', '', '' FROM customer UNION ALL SELECT {p} + o_orderkey, 'pointer_reference', 'POINTER', '' FROM orders UNION ALL SELECT id, 'struct_union', name || '|' || coalesce(CAST(bytesize AS VARCHAR), '-'), name FROM st{v} UNION ALL SELECT id, 'member', name || '|' || off, '' FROM mem{v} UNION ALL SELECT id, 'typedef', name, '' FROM td{v} UNION ALL SELECT id, 'primitive', name || '|' || bytesize, name FROM prim{v} UNION ALL SELECT {i}, 'interface', '', '')"
        f", edge{v} AS (SELECT {i} AS src, 'symbol' AS label, name AS key, id AS dst FROM sym{v} UNION ALL SELECT id, 'type', '', type_id FROM sym{v} UNION ALL SELECT {f} + c_custkey, 'return', '', {6 * KIND_RANGE + v * VERSION_RANGE} + 1000 + c_nationkey FROM customer UNION ALL SELECT function_id, 'parameter', CAST(pos AS VARCHAR), type_id FROM par{v} UNION ALL SELECT {p} + o_orderkey, 'pointee', '', {11 * KIND_RANGE + v * VERSION_RANGE} + o_orderkey FROM orders UNION ALL SELECT struct_id, 'member', mem{v}.name || '#' || nth, mem{v}.id FROM mem{v} JOIN st{v} ON st{v}.id = struct_id AND bytesize IS NOT NULL UNION ALL SELECT id, 'type', '', type_id FROM mem{v} UNION ALL SELECT id, 'referred', '', referred FROM td{v})"
    )


#: Edges with what makes their ends comparable; pairs that aren't are not followed.
_EDGED = ", ".join(f"edged{v} AS MATERIALIZED (SELECT src, label, key, dst, kind || ':' || tag AS t FROM edge{v} JOIN node{v} ON id = dst)" for v in (0, 1))
_PAIRS = (
    f"WITH RECURSIVE {_graph(0)}, {_graph(1)}, {_EDGED}, pairs AS (SELECT CAST({15 * KIND_RANGE} AS BIGINT) AS a, CAST({15 * KIND_RANGE + VERSION_RANGE} AS BIGINT) AS b, true AS comparable UNION SELECT x.dst, y.dst, x.t = y.t FROM pairs JOIN edged0 x ON x.src = a JOIN edged1 y ON y.src = b AND x.label = y.label AND x.key = y.key WHERE comparable), "
    "open AS (SELECT a, b FROM pairs WHERE comparable), "
    "links AS (SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, coalesce(l.label, r.label) AS label, coalesce(l.key, r.key) AS key, ca, cb FROM (SELECT a, b, label, key, dst AS ca FROM open JOIN edge0 ON src = a) l FULL JOIN (SELECT a, b, label, key, dst AS cb FROM open JOIN edge1 ON src = b) r ON l.a = r.a AND l.b = r.b AND l.label = r.label AND l.key = r.key), "
    "local AS (SELECT a, b FROM pairs JOIN node0 x ON x.id = a JOIN node1 y ON y.id = b WHERE NOT comparable OR x.local <> y.local UNION SELECT a, b FROM links WHERE ca IS NULL OR cb IS NULL), "
    "bad AS (SELECT a, b FROM local UNION SELECT l.a, l.b FROM links l JOIN bad ON l.ca = bad.a AND l.cb = bad.b) "
)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def both(spark: SparkSession, sf_dir: str) -> tuple[TableGraph, TableGraph]:
    return TableGraph(spark, sf_dir, 0), TableGraph(spark, sf_dir, 1)


# ---- symbols


@query("interface_diff", f"WITH {_sym(0)}, {_sym(1)} SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN a.name IS NULL THEN 'added' WHEN a.binding <> b.binding OR a.crc <> b.crc THEN 'changed' ELSE 'same' END AS status FROM sym0 a FULL JOIN sym1 b ON a.name = b.name")
def interface_diff(spark, sf_dir):
    """Removed, added and changed symbols by name."""
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.symbols().select("name", "binding", "crc") for g in (a, b)), ["name"])
    return found.select("name", diff.status(F.col("old") != F.col("new")).alias("status"))


@query("interface_diff_ignore_additions", f"WITH {_sym(0)}, {_sym(1)} SELECT a.name, CASE WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS status FROM sym0 a LEFT JOIN sym1 b ON a.name = b.name WHERE b.name IS NULL OR a.binding <> b.binding OR a.crc <> b.crc")
def interface_diff_ignore_additions(spark, sf_dir):
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.symbols().select("name", "binding", "crc") for g in (a, b)), ["name"], ignore_added=True)
    return found.select("name", diff.status(F.col("old") != F.col("new")).alias("status")).filter("status <> 'same'")


@query("symbol_attr_diff", f"WITH {_sym(0)}, {_sym(1)} SELECT a.name, 'binding changed from ' || lower(a.binding) || ' to ' || lower(b.binding) AS text FROM sym0 a JOIN sym1 b ON a.name = b.name WHERE a.binding <> b.binding")
def symbol_attr_diff(spark, sf_dir):
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.symbols().select("name", "binding") for g in (a, b)), ["name"]).filter("old is not null and new is not null")
    return found.select("name", diff.changed_from_to("binding", F.lower("old.binding"), F.lower("new.binding")).alias("text")).filter("text is not null")


@query("symbol_crc_diff", f"WITH {_sym(0)}, {_sym(1)} SELECT a.name, 'CRC changed from 0x' || lower(to_hex(a.crc)) || ' to 0x' || lower(to_hex(b.crc)) AS text FROM sym0 a JOIN sym1 b ON a.name = b.name WHERE a.crc <> b.crc")
def symbol_crc_diff(spark, sf_dir):
    a, b = both(spark, sf_dir)
    crc = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    found = diff.match(*(g.symbols().select("name", "crc") for g in (a, b)), ["name"]).filter("old is not null and new is not null")
    return found.select("name", diff.changed_from_to("CRC", crc("old.crc"), crc("new.crc")).alias("text")).filter("text is not null")


@query("crc_only_symbols", f"WITH {_sym(0)}, {_sym(1)} SELECT count(*) AS changed, count(*) FILTER (WHERE a.binding = b.binding) AS crc_only FROM sym0 a JOIN sym1 b ON a.name = b.name WHERE a.binding <> b.binding OR a.crc <> b.crc")
def crc_only_symbols(spark, sf_dir):
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.symbols().select("name", "binding", "crc") for g in (a, b)), ["name"]).filter("old is not null and new is not null and old <> new")
    return found.agg(F.count("*").alias("changed"), F.count(F.when(F.col("old.binding") == F.col("new.binding"), 1)).alias("crc_only"))


@query("crc_collapse", f"WITH {_sym(0)}, {_sym(1)}, c AS (SELECT a.name FROM sym0 a JOIN sym1 b ON a.name = b.name WHERE a.crc <> b.crc AND a.binding = b.binding) SELECT * FROM (SELECT name, CAST(NULL AS BIGINT) AS omitted FROM c ORDER BY name LIMIT 3) UNION ALL SELECT NULL, count(*) - 3 FROM c HAVING count(*) > 3")
def crc_collapse(spark, sf_dir):
    """The first three symbols with only CRC changes and how many are omitted: a report limit."""
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.symbols().select("name", "binding", "crc") for g in (a, b)), ["name"]).filter("old is not null and new is not null")
    return diff.top_with_rest(found.filter((F.col("old.crc") != F.col("new.crc")) & (F.col("old.binding") == F.col("new.binding"))).select("name"), "name", 3)


@query("added_removed_groups", f"WITH {_sym(0)}, {_sym(1)}, d AS (SELECT CASE WHEN b.name IS NULL THEN 'removed' ELSE 'added' END AS which, coalesce(a.name, b.name) AS name FROM sym0 a FULL JOIN sym1 b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL) SELECT which, count(*) AS n, min(name) AS first, max(name) AS last FROM d GROUP BY which")
def added_removed_groups(spark, sf_dir):
    found = interface_diff(spark, sf_dir).filter("status in ('removed', 'added')")
    return found.groupBy(F.col("status").alias("which")).agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("symbol_filter_glob", f"WITH {_sym(0)} SELECT name, crc FROM sym0 WHERE regexp_matches(name, '^Customer#.*1[0-4].$')")
def symbol_filter_glob(spark, sf_dir):
    s = TableGraph(spark, sf_dir, 0).symbols()
    return s.filter(compile_filter("Customer#*1[0-4]?", F.col("name"))).select("name", "crc")


@query("symbol_filter_expr", f"WITH {_sym(0)} SELECT name FROM sym0 WHERE (ends_with(name, '7') OR starts_with(name, 'Customer#00000000')) AND NOT (ends_with(name, '17') OR name IN ('Customer#000000027', 'Customer#000000003'))")
def symbol_filter_expr(spark, sf_dir):
    s = TableGraph(spark, sf_dir, 0).symbols()
    return s.filter(compile_filter("(*7 | Customer#00000000*) & !(*17 | :hidden)", F.col("name"), {"hidden": ["Customer#000000027", "Customer#000000003"]})).select("name")


# ---- types


@query("struct_definedness", f"WITH {_st(0)}, {_st(1)} SELECT a.name, CASE WHEN b.bytesize IS NULL THEN 'was fully defined, is now only declared' ELSE 'was only declared, is now fully defined' END AS text FROM st0 a JOIN st1 b ON a.name = b.name WHERE (a.bytesize IS NULL) <> (b.bytesize IS NULL)")
def struct_definedness(spark, sf_dir):
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.structs().select("name", "bytesize") for g in (a, b)), ["name"]).filter("(old.bytesize is null) <> (new.bytesize is null)")
    return found.select("name", F.when(F.col("new.bytesize").isNull(), "was fully defined, is now only declared").otherwise("was only declared, is now fully defined").alias("text"))


@query("struct_bytesize", f"WITH {_st(0)} SELECT bytesize, count(*) AS n FROM st0 GROUP BY bytesize")
def struct_bytesize(spark, sf_dir):
    return TableGraph(spark, sf_dir, 0).structs().groupBy("bytesize").agg(F.count("*").alias("n"))


@query("primitive_diff", f"WITH {_prim(0)}, {_prim(1)} SELECT a.name, 'byte size changed from ' || a.bytesize || ' to ' || b.bytesize AS text FROM prim0 a JOIN prim1 b ON a.name = b.name WHERE a.bytesize <> b.bytesize")
def primitive_diff(spark, sf_dir):
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.primitives().select("name", "bytesize") for g in (a, b)), ["name"])
    return found.select("name", diff.changed_from_to("byte size", F.col("old.bytesize").cast("string"), F.col("new.bytesize").cast("string")).alias("text")).filter("text is not null")


@query("member_match_occurrence", f"WITH {_mem(0)}, {_mem(1)} SELECT coalesce(a.ord, b.ord) AS ord, coalesce(a.name, b.name) AS name, coalesce(a.nth, b.nth) AS nth, a.off AS old_offset, b.off AS new_offset FROM mem0 a FULL JOIN mem1 b ON a.ord = b.ord AND a.name = b.name AND a.nth = b.nth")
def member_match_occurrence(spark, sf_dir):
    """Members matched by name and, among equal names of a struct, by occurrence."""
    sides = []
    for g in both(spark, sf_dir):
        rows = diff.occurrence(g.members(), ["struct_id", "name"], ["pos"])
        sides.append(rows.select((F.col("struct_id") - KINDS["struct_union"] * KIND_RANGE - g.version * VERSION_RANGE).alias("ord"), "name", "nth", "offset"))
    return diff.match(*sides, ["ord", "name", "nth"]).select("ord", "name", "nth", F.col("old.offset").alias("old_offset"), F.col("new.offset").alias("new_offset"))


@query("member_offset_diff", f"WITH {_mem(0)}, {_mem(1)} SELECT a.ord, a.name, a.nth, 'offset changed from ' || a.off || ' to ' || b.off AS text FROM mem0 a JOIN mem1 b ON a.ord = b.ord AND a.name = b.name AND a.nth = b.nth WHERE a.off <> b.off")
def member_offset_diff(spark, sf_dir):
    found = member_match_occurrence(spark, sf_dir)
    text = diff.changed_from_to("offset", F.col("old_offset").cast("string"), F.col("new_offset").cast("string"))
    return found.select("ord", "name", "nth", text.alias("text")).filter("text is not null")


@query("member_offset_runs", f"WITH {_mem(0)}, {_mem(1)}, d AS (SELECT a.ord, a.pos, b.off - a.off AS delta FROM mem0 a JOIN mem1 b ON a.ord = b.ord AND a.pos = b.pos), i AS (SELECT *, pos - row_number() OVER (PARTITION BY ord, delta ORDER BY pos) AS island FROM d) SELECT ord, delta, min(pos) AS first, max(pos) AS last, count(*) AS n FROM i GROUP BY ord, delta, island")
def member_offset_runs(spark, sf_dir):
    """Consecutive members of a struct that move by the same distance."""
    sides = [g.members().select((F.col("struct_id") - KINDS["struct_union"] * KIND_RANGE - g.version * VERSION_RANGE).alias("ord"), "pos", "offset") for g in both(spark, sf_dir)]
    moved = diff.match(*sides, ["ord", "pos"]).select("ord", "pos", (F.col("new.offset") - F.col("old.offset")).alias("delta"))
    return diff.runs(moved, ["ord"], "pos", "delta")


_ENUM = "e{v} AS (SELECT r_name AS enum_name, {name} AS name, CAST(n_nationkey AS BIGINT) AS value FROM region JOIN nation ON r_regionkey = n_regionkey {where})"


@query("enum_diff", "WITH " + _ENUM.format(v=0, name="n_name", where="") + ", " + _ENUM.format(v=1, name="CASE WHEN n_nationkey = 3 THEN n_name || '_NEW' ELSE n_name END", where="WHERE n_nationkey <> 7") + " SELECT coalesce(a.enum_name, b.enum_name) AS enum_name, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN a.name IS NULL THEN 'added' WHEN a.value <> b.value THEN 'changed' ELSE 'same' END AS status FROM e0 a FULL JOIN e1 b ON a.enum_name = b.enum_name AND a.name = b.name")
def enum_diff(spark, sf_dir):
    a, b = both(spark, sf_dir)
    found = diff.match(*(g.enumerators().select("enum_name", "name", "value") for g in (a, b)), ["enum_name", "name"])
    return found.select("enum_name", "name", diff.status(F.col("old.value") != F.col("new.value")).alias("status"))


@query("parameter_match", f"WITH {_par(0)}, c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT cust, pos, ord, c_nationkey AS nation FROM par0 JOIN c ON cust = c_custkey")
def parameter_match(spark, sf_dir):
    """Every parameter with its position and the nation that its function returns."""
    g = TableGraph(spark, sf_dir, 0)
    found = g.parameters().join(g.functions().withColumnRenamed("id", "function_id"), "function_id")
    return found.select((F.col("function_id") - KINDS["function"] * KIND_RANGE).alias("cust"), "pos", (F.col("type_id") - KINDS["pointer_reference"] * KIND_RANGE).alias("ord"), (F.col("return_type_id") - KINDS["primitive"] * KIND_RANGE - 1000).cast("int").alias("nation"))


@query("typedef_resolve", f"WITH {_prim(1)} SELECT td1.name, prim1.name AS resolved, prim1.bytesize FROM td1 JOIN prim1 ON referred = prim1.id")
def typedef_resolve(spark, sf_dir):
    g = TableGraph(spark, sf_dir, 1)
    return g.typedefs().join(g.primitives().select(F.col("id").alias("referred_type_id"), F.col("name").alias("resolved"), F.col("bytesize").cast("int").alias("bytesize")), "referred_type_id").select("name", "resolved", "bytesize")


# ---- graph


def _comparison(spark: SparkSession, sf_dir: str) -> Comparison:
    a, b = both(spark, sf_dir)
    return Comparison((a.nodes(), b.nodes()), (a.edges(), b.edges()), (15 * KIND_RANGE, 15 * KIND_RANGE + VERSION_RANGE))


@query("reachable_types", f"WITH RECURSIVE {_graph(0)}, r AS (SELECT CAST({15 * KIND_RANGE} AS BIGINT) AS id UNION SELECT dst FROM r JOIN edge0 ON src = id) SELECT kind, count(*) AS n FROM r JOIN node0 USING (id) GROUP BY kind")
def reachable_types(spark, sf_dir):
    """Nodes of each kind that the interface reaches."""
    g = TableGraph(spark, sf_dir, 0)
    found = reachable(g.edges(), spark.range(1).select(F.lit(15 * KIND_RANGE).cast("long").alias("id")))
    return found.join(g.nodes(), "id").groupBy("kind").agg(F.count("*").alias("n"))


@query("degree_histogram", f"WITH {_graph(0)} SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM edge0 GROUP BY src) GROUP BY degree")
def degree_histogram(spark, sf_dir):
    edges = TableGraph(spark, sf_dir, 0).edges()
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


@query("pair_expansion", _PAIRS + "SELECT a, b FROM pairs")
def pair_expansion(spark, sf_dir):
    return _comparison(spark, sf_dir).pairs


@query("unequal_pairs", _PAIRS + "SELECT a, b FROM bad")
def unequal_pairs(spark, sf_dir):
    """Pairs of nodes that differ or reach a difference."""
    return _comparison(spark, sf_dir).unequal()


@query("diff_outcomes", _PAIRS + "SELECT l.a, l.b, label, key, CASE WHEN cb IS NULL THEN 'removed' WHEN ca IS NULL THEN 'added' ELSE 'changed' END AS change FROM links l JOIN bad USING (a, b) LEFT JOIN bad e ON ca = e.a AND cb = e.b WHERE ca IS NULL OR cb IS NULL OR e.a IS NOT NULL")
def diff_outcomes(spark, sf_dir):
    """The details of every unequal pair: the difference graph."""
    return _comparison(spark, sf_dir).outcomes()


@query("holder_changes", _PAIRS + "SELECT kind, count(*) AS n FROM bad JOIN node0 ON a = id WHERE kind IN ('struct_union', 'primitive', 'typedef', 'interface') GROUP BY kind")
def holder_changes(spark, sf_dir):
    """Unequal named types, by kind."""
    kind = F.substring_index("of", " ", -1)
    found = _comparison(spark, sf_dir).unequal_of().select(kind.alias("kind"))
    return found.filter("kind in ('struct_union', 'primitive', 'typedef', 'interface')").groupBy("kind").agg(F.count("*").alias("n"))


@query("report_pieces")
def report_pieces(spark, sf_dir):
    """The difference graph cut into the pieces of a flat report, in its order; a small report has those that are interesting."""
    found = pieces(*_comparison(spark, sf_dir).graph(), f"{15 * KIND_RANGE}:{15 * KIND_RANGE + VERSION_RANGE}")
    return found.withColumn("path", F.concat_ws(" ", "path"))


# ---- fidelity


_LEVELS = "s{v} AS (SELECT name, CASE WHEN bytesize IS NULL THEN 1 ELSE 2 END AS level FROM st{v})"


@query("fidelity_types", f"WITH {_st(0)}, " + _LEVELS.format(v=0) + " SELECT level, count(*) AS n FROM s0 GROUP BY level")
def fidelity_types(spark, sf_dir):
    return _type_levels(TableGraph(spark, sf_dir, 0)).groupBy("level").agg(F.count("*").alias("n"))


def _type_levels(g: TableGraph) -> DataFrame:
    """1: only declared, 2: fully defined."""
    return g.structs().groupBy("name").agg(F.max(F.when(F.col("bytesize").isNull(), 1).otherwise(2)).alias("level"))


@query("fidelity_symbols", f"WITH {_sym(0)}, {_sym(1)}, f AS (SELECT name, max(v) AS last, count(*) AS versions FROM (SELECT name, 0 AS v FROM sym0 UNION ALL SELECT name, 1 FROM sym1) GROUP BY name) SELECT last, versions, count(*) AS n FROM f GROUP BY 1, 2")
def fidelity_symbols(spark, sf_dir):
    """How many symbols either version or both have."""
    a, b = (g.symbols().select("name", F.lit(g.version).alias("v")) for g in both(spark, sf_dir))
    return a.unionByName(b).groupBy("name").agg(F.max("v").alias("last"), F.count("*").alias("versions")).groupBy("last", "versions").agg(F.count("*").alias("n"))


@query("fidelity_transitions", f"WITH {_st(0)}, {_st(1)}, " + _LEVELS.format(v=0) + ", " + _LEVELS.format(v=1) + " SELECT coalesce(s0.level, 0) AS before, coalesce(s1.level, 0) AS after, count(*) AS n, min(coalesce(s0.name, s1.name)) AS least, max(coalesce(s0.name, s1.name)) AS greatest FROM s0 FULL JOIN s1 ON s0.name = s1.name GROUP BY 1, 2")
def fidelity_transitions(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return diff.transitions(_type_levels(a), _type_levels(b), "name", "level")


# ---- equivalence and hashes


@query("colour_classes", f"WITH {_mem(0)}, {_prim(0)}, m AS (SELECT mem0.id, mem0.name || '|' || off || '|' || td0.name AS c FROM mem0 JOIN td0 ON type_id = td0.id) SELECT count(*) AS nodes, count(DISTINCT c) AS classes FROM m")
def colour_classes(spark, sf_dir):
    """Members that no difference tells apart, over members, typedefs and primitives."""
    g = TableGraph(spark, sf_dir, 0)
    kinds = "kind in ('member', 'typedef', 'primitive')"
    mine = colours(g.nodes().filter(kinds), g.edges().filter("label in ('type', 'referred')"), ("kind",)).filter("kind = 'member'")
    return mine.agg(F.count("*").alias("nodes"), F.countDistinct("colour").alias("classes"))


@query("dedupe_edges", f"WITH {_mem(0)}, {_prim(0)}, m AS (SELECT mem0.id, mem0.name || '|' || off || '|' || td0.name AS c FROM mem0 JOIN td0 ON type_id = td0.id) SELECT id, min(id) OVER (PARTITION BY c) AS keep_id FROM m")
def dedupe_edges(spark, sf_dir):
    """Each member and the one that stands for its class: the smallest id."""
    g = TableGraph(spark, sf_dir, 0)
    mine = colours(g.nodes().filter("kind in ('member', 'typedef', 'primitive')"), g.edges().filter("label in ('type', 'referred')"), ("kind",)).filter("kind = 'member'")
    # the least id is a partial aggregate, joined back: no class is gathered
    return mine.join(mine.groupBy("colour").agg(F.min("id").alias("keep_id")), "colour").select("id", "keep_id")


@query("order_components", "WITH RECURSIVE e AS (SELECT l_orderkey * 2 AS x, l_suppkey * 2 + 1 AS y FROM lineitem WHERE l_quantity >= 49 AND l_linenumber = 1 GROUP BY 1, 2), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS id, x AS least FROM b UNION SELECT b.y, r.least FROM r JOIN b ON b.x = r.id) SELECT id, min(least) AS component FROM r GROUP BY id")
def order_components(spark, sf_dir):
    """Orders and suppliers that large first lines connect: union-find as label propagation."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 and l_linenumber = 1")
    return components(lines.select((F.col("l_orderkey") * 2).alias("x"), (F.col("l_suppkey") * 2 + 1).alias("y")))


@query("version_classes")
def version_classes(spark, sf_dir):
    """Colour classes over all nodes of both versions, by kind: how many each version has and shares; the interface kind compares the roots."""
    a, b = both(spark, sf_dir)
    nodes = a.nodes().withColumn("v", F.lit(0)).unionByName(b.nodes().withColumn("v", F.lit(1)))
    found = colours(nodes, a.edges().unionByName(b.edges()), ("kind", "v"))
    one = found.groupBy("kind", "colour").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("nodes"))
    count = lambda c: F.count(F.when(c, 1))
    return one.groupBy("kind").agg(F.sum("nodes").alias("nodes"), count(F.col("first") == 0).alias("before"), count(F.col("last") == 1).alias("after"), count(F.col("first") < F.col("last")).alias("shared"))


@query("dedupe_graph")
def dedupe_graph(spark, sf_dir):
    """The edges of version 0 with every end, the root too, replaced by the smallest id of its class."""
    g = TableGraph(spark, sf_dir, 0)
    found = colours(g.nodes(), g.edges())
    keep = found.join(found.groupBy("colour").agg(F.min("id").alias("keep_id")), "colour").select("id", "keep_id")
    src, dst = (keep.select(F.col("id").alias(c), F.col("keep_id").alias(f"{c}_id")) for c in ("src", "dst"))
    return g.edges().join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), "label", "key", F.col("dst_id").alias("dst")).distinct()


@query("supplier_components")
def supplier_components(spark, sf_dir):
    """Orders and suppliers that any line connects: union-find over the whole of lineitem."""
    return components(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("x"), (F.col("l_suppkey") * 2 + 1).alias("y")))


@query("resolve_decls", f"WITH {_st(0)}, {_st(1)} SELECT name, count(*) FILTER (WHERE bytesize IS NULL) AS declared, count(DISTINCT bytesize) AS definitions, CASE WHEN count(DISTINCT bytesize) = 1 THEN max(bytesize) END AS resolved FROM (SELECT name, bytesize FROM st0 UNION ALL SELECT name, bytesize FROM st1) GROUP BY name HAVING count(*) FILTER (WHERE bytesize IS NULL) > 0")
def resolve_decls(spark, sf_dir):
    """Declarations that the one definition of their name resolves."""
    a, b = both(spark, sf_dir)
    every = a.structs().select("name", "bytesize").unionByName(b.structs().select("name", "bytesize"))
    found = every.groupBy("name").agg(F.count(F.when(F.col("bytesize").isNull(), 1)).alias("declared"), F.min("bytesize").alias("least"), F.max("bytesize").alias("most")).filter("declared > 0")
    definitions = F.when(F.col("least").isNull(), 0).when(F.col("least") == F.col("most"), 1).otherwise(2)
    return found.select("name", "declared", definitions.cast("long").alias("definitions"), F.when(F.col("least") == F.col("most"), F.col("most")).alias("resolved"))


@query("merge_conflicts", f"WITH {_sym(0)}, {_sym(1)} SELECT name, count(*) AS n FROM (SELECT name FROM sym0 UNION ALL SELECT name FROM sym1) GROUP BY name HAVING count(*) > 1")
def merge_conflicts(spark, sf_dir):
    """Symbols that both inputs of a merge define."""
    a, b = both(spark, sf_dir)
    return a.symbols().select("name").unionByName(b.symbols().select("name")).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


@query("symbol_ids")
def symbol_ids(spark, sf_dir):
    """Stable 32-bit ids of symbols: a tag combined with the hash of the name."""
    s = TableGraph(spark, sf_dir, 0).symbols()
    return s.select("name", hex32(combine(mix32(F.lit(ord("s")).cast("long")), fnv1a(F.col("name")))).alias("hash_id"))


# ---- matching and differences of two versions


@query("parameter_diff", f"WITH {_par(0)}, {_par(1)} SELECT coalesce(a.cust, b.cust) AS cust, coalesce(a.pos, b.pos) AS pos, a.ord AS old_ord, b.ord AS new_ord, CASE WHEN b.ord IS NULL THEN 'removed' WHEN a.ord IS NULL THEN 'added' ELSE 'changed' END AS status FROM par0 a FULL JOIN par1 b ON a.cust = b.cust AND a.pos = b.pos WHERE a.ord IS DISTINCT FROM b.ord")
def parameter_diff(spark, sf_dir):
    """Parameters of the functions of two versions by position; the longer list's tail is added or removed."""
    of = lambda g, c, kind: (F.col(c) - KINDS[kind] * KIND_RANGE - g.version * VERSION_RANGE).cast("long")
    sides = [g.parameters().select(of(g, "function_id", "function").alias("cust"), "pos", of(g, "type_id", "pointer_reference").alias("ord")) for g in both(spark, sf_dir)]
    found = diff.match(*sides, ["cust", "pos"]).withColumn("status", diff.status(F.col("old.ord") != F.col("new.ord")))
    return found.filter("status <> 'same'").select("cust", "pos", F.col("old.ord").alias("old_ord"), F.col("new.ord").alias("new_ord"), "status")


def _qualifier_sets(v: int) -> str:
    return f"q{v} AS (" + " UNION ALL ".join(f"SELECT p_partkey AS part, '{q}' AS qualifier FROM part WHERE (p_size + {v}) % {n} = 0" for q, n in (("const", 2), ("volatile", 3), ("restrict", 5))) + ")"


def _qualifiers(g: TableGraph) -> DataFrame:
    """(part, qualifier): the sets that the chains of qualified types hold, and a null row for every part."""
    links = g.qualifiers()
    held = links.join(chains(links), "id").select((F.col("end") - KINDS["typedef"] * KIND_RANGE - g.version * VERSION_RANGE).alias("part"), "qualifier")
    return held.unionByName(table(g.spark, g.sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit(None).cast("string").alias("qualifier")))


@query("qualifier_diff", f"WITH {_qualifier_sets(0)}, {_qualifier_sets(1)} SELECT coalesce(a.part, b.part) AS part, coalesce(a.qualifier, b.qualifier) AS qualifier, 'qualifier ' || coalesce(a.qualifier, b.qualifier) || CASE WHEN b.part IS NULL THEN ' removed' ELSE ' added' END AS text FROM q0 a FULL JOIN q1 b ON a.part = b.part AND a.qualifier = b.qualifier WHERE a.part IS NULL OR b.part IS NULL")
def qualifier_diff(spark, sf_dir):
    """Qualifiers that a type gains or loses, whatever the order of the chain that holds them."""
    a, b = (_qualifiers(g) for g in both(spark, sf_dir))
    return diff.set_changes(a, b, ["part"], "qualifier", "qualifier")


_ALIAS = "al{v} AS (SELECT p_partkey AS id, {to} AS next FROM part WHERE p_partkey > 0), ch{v} AS (SELECT id AS part, next, CAST(1 AS BIGINT) AS steps FROM al{v} UNION ALL SELECT part, al{v}.next, steps + 1 FROM ch{v} JOIN al{v} ON ch{v}.next = al{v}.id), en{v} AS (SELECT part, max(steps) AS steps, min(next) AS last FROM ch{v} GROUP BY part)"


@query("typedef_chain_diff", "WITH RECURSIVE " + _ALIAS.format(v=0, to="p_partkey // 4") + ", " + _ALIAS.format(v=1, to="CASE WHEN p_partkey % 7 = 0 THEN p_partkey - 1 ELSE p_partkey // 4 END") + " SELECT 'part_' || a.part AS name, a.steps AS old_steps, b.steps AS new_steps, b.last AS resolved FROM en0 a JOIN en1 b USING (part) WHERE a.steps <> b.steps")
def typedef_chain_diff(spark, sf_dir):
    """Typedefs whose chain of typedefs is longer or shorter than before, with the part that they resolve to."""
    sides = []
    for g in both(spark, sf_dir):
        links = g.aliases()
        sides.append(links.select("id", "name").join(chains(links), "id").select("name", "steps", (F.col("end") - KINDS["typedef"] * KIND_RANGE - g.version * VERSION_RANGE).alias("end")))
    found = diff.match(*sides, ["name"]).filter(F.col("old.steps") != F.col("new.steps"))
    return found.select("name", F.col("old.steps").alias("old_steps"), F.col("new.steps").alias("new_steps"), F.col("new.end").alias("resolved"))


@query("anonymous_keys", f"WITH {_mem(0)}, named AS (SELECT ord, arg_min(name, pos) || '+' AS key FROM mem0 WHERE type_id % 2 = 1 GROUP BY ord), k AS (SELECT o_custkey AS cust, o_orderkey AS ord, coalesce(key, '') AS key FROM orders LEFT JOIN named ON o_orderkey = ord) SELECT cust, ord, CASE WHEN key = '' THEN '#anon#' || (row_number() OVER (PARTITION BY cust, key = '' ORDER BY ord) - 1) ELSE key END AS key FROM k")
def anonymous_keys(spark, sf_dir):
    """Matching keys of nameless structs: the first named member with a plus, else a number among those without; members of even parts are nameless too."""
    g = TableGraph(spark, sf_dir, 0)
    named = g.members().filter("type_id % 2 = 1").groupBy("struct_id").agg(F.min(F.struct("pos", "name")).alias("first"))
    named = named.select((F.col("struct_id") - KINDS["struct_union"] * KIND_RANGE).alias("ord"), F.concat("first.name", F.lit("+")).alias("key"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"))
    return diff.anonymous_keys(orders.join(named, "ord", "left").select("cust", "ord", F.coalesce("key", F.lit("")).alias("key")), ["cust"], ["ord"], "key")


_DIFFERENCES = (
    f"{_sym(0)}, {_sym(1)}, {_st(0)}, {_st(1)}, {_qualifier_sets(0)}, {_qualifier_sets(1)}, d AS ("
    "SELECT CASE WHEN a.name IS NULL THEN 'interface_addition' END AS what, a.name IS NULL AS added FROM sym0 a FULL JOIN sym1 b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL "
    "UNION ALL SELECT NULL, false FROM sym0 a JOIN sym1 b ON a.name = b.name WHERE a.binding <> b.binding "
    "UNION ALL SELECT 'linux_symbol_crc', false FROM sym0 a JOIN sym1 b ON a.name = b.name WHERE a.crc <> b.crc "
    "UNION ALL SELECT 'type_declaration_status', b.bytesize IS NOT NULL FROM st0 a JOIN st1 b ON a.name = b.name WHERE (a.bytesize IS NULL) <> (b.bytesize IS NULL) "
    "UNION ALL SELECT 'qualifier', b.part IS NOT NULL FROM q0 a FULL JOIN q1 b ON a.part = b.part AND a.qualifier = b.qualifier WHERE a.part IS NULL OR b.part IS NULL)"
)


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, added): every difference of symbols, definitions and qualifiers, by the flag that covers it."""
    a, b = both(spark, sf_dir)
    symbols = diff.match(*(g.symbols().select("name", "binding", "crc") for g in (a, b)), ["name"])
    both_there = symbols.filter("old is not null and new is not null")
    structs = diff.match(*(g.structs().select("name", "bytesize") for g in (a, b)), ["name"]).filter("(old.bytesize is null) <> (new.bytesize is null)")
    row = lambda df, what, added: df.select(F.lit(what).cast("string").alias("what") if what is None or isinstance(what, str) else what.alias("what"), added.alias("added"))
    parts = [
        row(symbols.filter("old is null or new is null"), F.when(F.col("old").isNull(), "interface_addition"), F.col("old").isNull()),
        row(both_there.filter("old.binding <> new.binding"), None, F.lit(False)),
        row(both_there.filter("old.crc <> new.crc"), "linux_symbol_crc", F.lit(False)),
        row(structs, "type_declaration_status", F.col("new.bytesize").isNotNull()),
        row(qualifier_diff(spark, sf_dir), "qualifier", F.col("text").endswith("added")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ignored_differences", f"WITH {_DIFFERENCES}, f AS (SELECT unnest({list(diff.IGNORES)!r}) AS flag) SELECT flag, count(*) AS heeded FROM d, f WHERE NOT coalesce(CASE WHEN flag = 'type_definition_addition' THEN what = 'type_declaration_status' AND added WHEN flag = 'interface_addition' THEN what = flag AND added ELSE what = flag END, false) GROUP BY flag")
def ignored_differences(spark, sf_dir):
    """How many differences count under each of the nine ignore flags, in one pass."""
    flags = F.array(*(F.struct(F.lit(f).alias("flag"), diff.heeded(F.col("what"), F.col("added"), {f}).alias("heeded")) for f in diff.IGNORES))
    found = differences(spark, sf_dir).select(F.explode(flags).alias("x"))
    return found.filter("x.heeded").groupBy(F.col("x.flag").alias("flag")).agg(F.count("*").alias("heeded"))


# ---- edges rewritten


@query("merged_edges", f"WITH {_mem(0)}, {_prim(0)}, {_mem(1)}, {_prim(1)} SELECT id AS src, 'type' AS label, type_id AS dst FROM mem0 UNION SELECT id, 'referred', referred FROM td0 UNION SELECT mem1.id, 'type', td0.id FROM mem1 JOIN td1 ON type_id = td1.id JOIN td0 ON td0.name = td1.name UNION SELECT td0.id, 'referred', prim0.id FROM td1 JOIN td0 ON td0.name = td1.name JOIN prim1 ON td1.referred = prim1.id JOIN prim0 ON prim0.name = prim1.name")
def merged_edges(spark, sf_dir):
    """Version 1 merged into version 0: typedefs and primitives of one name become one, and the edges of members and typedefs follow."""
    a, b = both(spark, sf_dir)
    named = lambda g, kind: getattr(g, kind)().select("id", F.lit(kind).alias("kind"), "name")
    old, new = (named(g, "typedefs").unionByName(named(g, "primitives")) for g in (a, b))
    mapping = new.join(old.withColumnRenamed("id", "to"), ["kind", "name"]).select("id", "to")
    edge = lambda df, src, label, dst: df.select(F.col(src).alias("src"), F.lit(label).alias("label"), F.lit("").alias("key"), F.col(dst).alias("dst"))
    sides = [edge(g.members(), "id", "type", "type_id").unionByName(edge(g.typedefs(), "id", "referred", "referred_type_id")) for g in (a, b)]
    return sides[0].unionByName(diff.remap(sides[1], mapping)).distinct().select("src", "label", "dst")


@query("resolved_edges", f"WITH {_st(0)}, {_st(1)}, p AS (SELECT {2 * KIND_RANGE} + o_orderkey AS src, {11 * KIND_RANGE} + o_orderkey AS old_dst FROM orders UNION ALL SELECT {2 * KIND_RANGE + VERSION_RANGE} + o_orderkey, {11 * KIND_RANGE + VERSION_RANGE} + o_orderkey FROM orders), s AS (SELECT * FROM st0 UNION ALL SELECT * FROM st1), d AS (SELECT name, min(id) AS id FROM s WHERE bytesize IS NOT NULL GROUP BY name HAVING count(*) = 1) SELECT src, old_dst, d.id AS dst FROM p JOIN s ON s.id = old_dst AND s.bytesize IS NULL JOIN d ON d.name = s.name")
def resolved_edges(spark, sf_dir):
    """Pointers to structs that are only declared, moved to the one definition that the two versions have of the name."""
    a, b = both(spark, sf_dir)
    structs = a.structs().unionByName(b.structs()).select("id", "name", "bytesize")
    defined = structs.filter("bytesize is not null").groupBy("name").agg(F.min("id").alias("to"), F.count("*").alias("n")).filter("n = 1").select("name", "to")
    mapping = structs.filter("bytesize is null").join(defined, "name").select(F.col("id").alias("old_dst"), F.col("to").alias("dst"))
    pointers = a.pointers().unionByName(b.pointers()).select(F.col("id").alias("src"), F.col("pointee_type_id").alias("old_dst"))
    return pointers.join(mapping, "old_dst").select("src", "old_dst", "dst")
