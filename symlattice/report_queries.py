"""Registered queries over the lines of a report, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.operators import diff
from symlattice.plans import report
from symlattice.plans.compare import union
from symlattice.plans.pieces import numbered
from symlattice.queries import _mem, _st, _sym, both, query
from symlattice.session import checkpoint
from symlattice.sources.tables import KIND_RANGE, KINDS, VERSION_RANGE

#: Symbols with nothing but a new CRC that a short report names.
CRC_LIMIT = 3
#: Place of a section's blank line, behind all members.
_END = 1 << 40


def _lines(df: DataFrame, block, name, pos, lines: list) -> DataFrame:
    """(block, name, pos, part, line): the lines of a row that aren't null, in order."""
    each = df.select(block.cast("int").alias("block"), name.alias("name"), pos.cast("long").alias("pos"), F.posexplode(F.array(*lines)).alias("part", "line"))
    return each.filter("line is not null")


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, name, pos, part, line) of every symbol that came, went or changed by itself, and every struct whose definition or members did."""
    a, b = both(spark, sf_dir)
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    symbols = diff.match(*(g.symbols().select("name", "binding", "crc") for g in (a, b)), ["name"]).filter("old is null or new is null or old <> new")
    here = lambda side: F.when(F.col(side).isNotNull(), F.col("name"))
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    block = F.when(F.col("new").isNull(), 0).when(F.col("old").isNull(), 1).otherwise(2)
    inner = lambda what, f, c: F.when(there, F.concat(F.lit("  "), diff.changed_from_to(what, f(F.col(f"old.{c}")), f(F.col(f"new.{c}")))))
    parts = [_lines(symbols, block, F.col("name"), F.lit(0), [report.comparison_line(F.lit("function symbol"), here("old"), here("new")), inner("binding", F.lower, "binding"), inner("CRC", hexed, "crc"), F.lit("")])]

    structs = diff.match(*(g.structs().select("name", "bytesize") for g in (a, b)), ["name"]).filter("old is not null and new is not null")
    structs = structs.select("name", F.col("old.bytesize").isNotNull().alias("was"), F.col("new.bytesize").isNotNull().alias("is"))
    turned = structs.filter("was <> is").select("name", F.when(F.col("was"), "  was fully defined, is now only declared").otherwise("  was only declared, is now fully defined").alias("text"))
    sides = []
    for g in (a, b):
        rows = diff.occurrence(g.members(), ["struct_id", "name"], ["pos"])
        typed = F.concat(F.lit("part_"), (F.col("type_id") - KINDS["typedef"] * KIND_RANGE - g.version * VERSION_RANGE).cast("string"), F.lit(" "), "name")
        sides.append(rows.select((F.col("struct_id") - KINDS["struct_union"] * KIND_RANGE - g.version * VERSION_RANGE).alias("ord"), F.col("name").alias("member"), "nth", "pos", "offset", typed.alias("said")))
    members = diff.match(*sides, ["ord", "member", "nth"]).filter("old is null or new is null or old.offset <> new.offset or old.said <> new.said")
    members = members.withColumn("name", F.concat(F.lit("order_"), F.col("ord").cast("string"))).join(structs.filter("was and is").select("name"), "name", "left_semi")
    moved = checkpoint(members.select("name", F.coalesce("old.pos", "new.pos").alias("pos"), report.comparison_line(F.lit("member"), F.col("old.said"), F.col("new.said")).alias("said"), diff.changed_from_to("offset", F.col("old.offset").cast("string"), F.col("new.offset").cast("string")).alias("offset"), (F.col("old").isNotNull() & F.col("new").isNotNull()).alias("both")))
    heads = checkpoint(turned.unionByName(moved.select("name", F.lit(None).cast("string").alias("text")).distinct()))
    struct = F.concat(F.lit("struct "), "name")
    type_block = F.lit(3)
    parts.append(_lines(heads, type_block, F.col("name"), F.lit(0), [report.comparison_line(F.lit("type"), struct, struct), F.col("text")]))
    parts.append(_lines(moved, type_block, F.col("name"), F.col("pos"), [F.concat(F.lit("  "), "said"), F.when(F.col("both"), F.concat(F.lit("    "), "offset"))]))
    parts.append(_lines(heads, type_block, F.col("name"), F.lit(_END), [F.lit("")]))
    return union(parts)


_FLAT = (
    f"{_sym(0)}, {_sym(1)}, {_st(0)}, {_st(1)}, {_mem(0)}, {_mem(1)}, "
    "said AS (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 0 WHEN a.name IS NULL THEN 1 ELSE 2 END AS block, a.binding AS ab, b.binding AS bb, a.crc AS ac, b.crc AS bc FROM sym0 a FULL JOIN sym1 b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.binding <> b.binding OR a.crc <> b.crc), "
    "structs AS (SELECT a.name, a.bytesize IS NOT NULL AS was, b.bytesize IS NOT NULL AS is_now FROM st0 a JOIN st1 b ON a.name = b.name), "
    f"moved AS (SELECT 'order_' || a.ord AS name, a.pos, 'part_' || (a.type_id - {4 * KIND_RANGE}) || ' ' || a.name AS what, a.off AS o, b.off AS n FROM mem0 a JOIN mem1 b ON a.ord = b.ord AND a.name = b.name AND a.nth = b.nth JOIN structs s ON s.name = 'order_' || a.ord AND was AND is_now WHERE a.off <> b.off), "
    "heads AS (SELECT name, CASE WHEN was THEN '  was fully defined, is now only declared' ELSE '  was only declared, is now fully defined' END AS text FROM structs WHERE was <> is_now UNION ALL SELECT DISTINCT name, NULL FROM moved), "
    "flat AS (SELECT block, name, 0 AS pos, 0 AS part, 'function symbol ''' || name || ''' ' || CASE block WHEN 0 THEN 'was removed' WHEN 1 THEN 'was added' ELSE 'changed' END AS line FROM said "
    "UNION ALL SELECT block, name, 0, 1, '  binding changed from ' || lower(ab) || ' to ' || lower(bb) FROM said WHERE ab <> bb UNION ALL SELECT block, name, 0, 2, '  CRC changed from 0x' || lower(to_hex(ac)) || ' to 0x' || lower(to_hex(bc)) FROM said WHERE ac <> bc UNION ALL SELECT block, name, 0, 3, '' FROM said "
    "UNION ALL SELECT 3, name, 0, 0, 'type ''struct ' || name || ''' changed' FROM heads UNION ALL SELECT 3, name, 0, 1, text FROM heads WHERE text IS NOT NULL "
    f"UNION ALL SELECT 3, name, pos, 0, '  member ''' || what || ''' changed' FROM moved UNION ALL SELECT 3, name, pos, 1, '    offset changed from ' || o || ' to ' || n FROM moved UNION ALL SELECT 3, name, {_END}, 0, '' FROM heads), "
    "lines AS MATERIALIZED (SELECT row_number() OVER (ORDER BY block, name, pos, part) - 1 AS rank, line FROM flat)"
)


@query("report_lines", f"WITH {_FLAT} SELECT rank, line FROM lines")
def report_lines(spark, sf_dir):
    """The flat report of symbols and of structs' members: symbols that went, came, changed, then types, each section with a blank line behind it."""
    return numbered(flat_lines(spark, sf_dir), ["block", "name", "pos", "part"], 0, "rank").select("rank", "line")


def _near(lines: str) -> str:
    return f"SELECT rank, line, lag(line, 2) OVER w AS b2, lag(line) OVER w AS b1, lead(line) OVER w AS a1, lead(line, 2) OVER w AS a2 FROM {lines} WINDOW w AS (ORDER BY rank)"


def _fits(x: str, shape: str) -> str:
    return f"coalesce(regexp_matches({x}, '{shape.replace("'", "''")}'), false)"


def _crc(a: str, b: str, c: str) -> str:
    return f"({_fits(a, report.SYMBOL_CHANGED)} AND {_fits(b, report.CRC_CHANGED)} AND coalesce({c} = '', false))"


def _move(a: str, b: str, c: str) -> str:
    inset = lambda x: f"length(regexp_extract({x}, '^( *)', 1))"
    good = f"{_fits(a, report.MEMBER_CHANGED)} AND {_fits(b, report.OFFSET_CHANGED)} AND {c} IS NOT NULL AND {inset(a)} + 2 = {inset(b)} AND {inset(a)} >= {inset(c)}"
    end = lambda k: f"CAST(regexp_extract({b}, '{report.OFFSET_CHANGED}', {k}) AS BIGINT)"
    return f"CASE WHEN {good} THEN {{'inset': {inset(a)}, 'delta': {end(3)} - {end(2)}}} END"


_CAME = report.SYMBOL_CAME_OR_WENT
_MEMBER = report.MEMBER_CHANGED.replace("'", "''")
_SHORT = (
    f"n1 AS ({_near('lines')}), m1 AS (SELECT rank, line, {_crc('line', 'a1', 'a2')} AS starts, {_crc('line', 'a1', 'a2')} OR {_crc('b1', 'line', 'a1')} OR {_crc('b2', 'b1', 'line')} AS only_crc, sum(CASE WHEN {_fits('line', report.SECTION)} AND NOT {_fits('line', report.SYMBOL)} THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS region FROM n1), "
    "k1 AS (SELECT *, count(*) FILTER (WHERE starts) OVER (PARTITION BY region ORDER BY rank) AS nth FROM m1), r1 AS (SELECT region, count(*) AS n FROM m1 WHERE starts GROUP BY region), "
    f"o1 AS (SELECT region, CAST(only_crc AS INT) AS stage, rank AS part, line FROM k1 WHERE NOT only_crc OR nth <= {CRC_LIMIT} UNION ALL SELECT region, 2, 0, '... ' || (n - {CRC_LIMIT}) || ' omitted; ' || n || ' symbols have only CRC changes' FROM r1 WHERE n > {CRC_LIMIT} UNION ALL SELECT region, 2, 1, '' FROM r1 WHERE n > {CRC_LIMIT}), "
    "l1 AS (SELECT row_number() OVER (ORDER BY region, stage, part) - 1 AS rank, line FROM o1), "
    f"n2 AS ({_near('l1')}), m2 AS (SELECT rank, line, {_fits('line', _CAME)} AND coalesce(a1 = '', false) AS symbol, {_fits('b1', _CAME)} AND line = '' AS blank FROM n2), "
    f"k2 AS (SELECT *, sum(CASE WHEN symbol OR blank THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS run, CASE regexp_extract(line, '{_CAME}', 3) WHEN 'removed' THEN 1 ELSE 2 END AS which, regexp_extract(line, '{_CAME}', 1) AS kind, regexp_extract(line, '{_CAME}', 2) AS name FROM m2), "
    "g2 AS (SELECT run, which, kind, count(*) AS n FROM k2 WHERE symbol GROUP BY ALL), "
    "o2 AS (SELECT run, 0 AS which, '' AS kind, 0 AS part, rank, line FROM k2 WHERE NOT symbol AND NOT blank UNION ALL SELECT run, which, kind, 1, rank, '  ' || name FROM k2 WHERE symbol UNION ALL SELECT run, which, kind, 0, 0, n || ' ' || kind || ' symbol(s) ' || CASE which WHEN 1 THEN 'removed' ELSE 'added' END FROM g2 UNION ALL SELECT run, which, kind, 2, 0, '' FROM g2), "
    "l2 AS (SELECT row_number() OVER (ORDER BY run, which, kind, part, rank) - 1 AS rank, line FROM o2), "
    f"n3 AS ({_near('l2')}), m3 AS (SELECT rank, line, {_move('line', 'a1', 'a2')} AS move, {_move('b2', 'b1', 'line')} AS before, ({_move('b1', 'line', 'a1')}) IS NOT NULL AS second FROM n3), "
    "k3 AS (SELECT *, sum(CASE WHEN NOT second AND (move IS NULL OR before IS NULL OR move <> before) THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS run FROM m3), "
    f"g3 AS (SELECT run, count(*) AS n, min(move) AS move, arg_min(line, rank) AS line, regexp_extract(arg_min(line, rank), '{_MEMBER}', 2) AS a, regexp_extract(arg_max(line, rank), '{_MEMBER}', 2) AS z FROM k3 WHERE NOT second GROUP BY run), "
    "o3 AS (SELECT run, 0 AS part, CASE WHEN move IS NULL THEN line ELSE repeat(' ', move.inset) || CASE WHEN n = 1 THEN 'member ' || a ELSE n || ' members (' || a || ' .. ' || z || ')' END || ' changed' END AS line FROM g3 UNION ALL SELECT run, 1, repeat(' ', move.inset) || '  offset changed by ' || move.delta FROM g3 WHERE move IS NOT NULL)"
)


@query("short_report", f"WITH {_FLAT}, {_SHORT} SELECT row_number() OVER (ORDER BY run, part) - 1 AS rank, line FROM o3")
def short_report(spark, sf_dir):
    """The flat report in short: a few of the symbols with only a new CRC, symbols that came or went in groups, members that moved together in one line."""
    return report.short(report_lines(spark, sf_dir), CRC_LIMIT)
