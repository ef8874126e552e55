"""Lines of reports, and the collapse of a report into a short one.

A report is a table of (rank, line), ranks dense from 0. What a line means may
depend on its neighbours and on the run it stands in, so ranks are cut into
buckets: neighbours across an edge are copied to both sides, and running values
carry each bucket's total to the next, bucket totals being a smaller table of
the same form. No task sees more than a bucket of lines, wherever they come from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.plans.pieces import numbered
from symlattice.session import checkpoint, free

#: Lines of a bucket.
BUCKET = 1 << 16

#: Shapes of lines; fixed values of the report format.
SYMBOL_CHANGED = r"^.* symbol .* changed$"
CRC_CHANGED = r"^  CRC changed from [^ ]* to [^ ]*$"
SYMBOL = r"^.* symbol .*$"
SECTION = r"^[^ ].*$"
SYMBOL_CAME_OR_WENT = r"^(.*) symbol (.*) was (added|removed)$"
MEMBER_CHANGED = r"^( *)member ('.*') changed$"
OFFSET_CHANGED = r"^( *)offset changed from (\d+) to (\d+)$"


def comparison_line(kind: Column, old: Column, new: Column) -> Column:
    """What is said of a pair of descriptions of which one may be null: removed, added, changed, or changed from one to the other."""
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    said = F.when(new.isNull(), F.concat(quoted(old), F.lit(" was removed"))).when(old.isNull(), F.concat(quoted(new), F.lit(" was added")))
    return F.concat(kind, F.lit(" "), said.when(old == new, F.concat(quoted(old), F.lit(" changed"))).otherwise(F.concat(F.lit("changed from "), quoted(old), F.lit(" to "), quoted(new))))


def with_near(lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """lines with before2, before1, after1 and after2, the two lines on either side; null past the ends. A bucket holds at least two lines."""
    at, place = F.expr(f"rank div {bucket}"), F.expr(f"rank % {bucket}")
    homes = F.array(at, F.when((place < 2) & (at > 0), at - 1), F.when(place >= bucket - 2, at + 1))
    spread = lines.select("rank", "line", at.alias("__home"), F.explode(homes).alias("__at")).filter("__at is not null")
    w = Window.partitionBy("__at").orderBy("rank")
    near = {f"before{k}": F.lag("line", k).over(w) for k in (2, 1)} | {f"after{k}": F.lead("line", k).over(w) for k in (1, 2)}
    return spread.withColumns(near).filter("__home = __at").drop("__home", "__at")


def running(df: DataFrame, name: str, value: Column, fold: Callable[[Column], Column], rows: int, bucket: int = BUCKET, rank: str = "rank") -> DataFrame:
    """df with the sum or maximum of value over all rows up to this one. Ranks are dense from 0; rows is their number."""
    at = F.expr(f"`{rank}` div {bucket}")
    here = df.withColumn("__in", at)
    here = here.withColumn(name, fold(value).over(Window.partitionBy("__in").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)))
    if rows <= bucket:
        return here.drop("__in")
    totals = df.groupBy(at.alias("__bucket")).agg(fold(value).alias("__total"))
    totals = running(totals, "__run", F.col("__total"), fold, -(-rows // bucket), bucket, "__bucket").select((F.col("__bucket") + 1).alias("__in"), F.col("__run").alias("__carried"))
    both = F.coalesce(F.col(name) + F.col("__carried"), name, "__carried") if fold is F.sum else F.greatest(name, "__carried")
    return here.join(totals, "__in", "left").withColumn(name, both).drop("__in", "__carried")


def _fits(line: Column, shape: str) -> Column:
    return F.coalesce(line.rlike(shape), F.lit(False))


def _number_of(lines: DataFrame) -> int:
    return lines.agg(F.count("*").alias("n")).first()["n"]


def without_crc_changes(lines: DataFrame, limit: int, bucket: int = BUCKET) -> DataFrame:
    """lines in which symbols with nothing but a new CRC stand last before the next section that is no symbol, the first of them up to limit; how many more there are is said."""
    starts = lambda a, b, c: _fits(a, SYMBOL_CHANGED) & _fits(b, CRC_CHANGED) & F.coalesce(c == "", F.lit(False))
    line, b2, b1, a1, a2 = (F.col(c) for c in ("line", "before2", "before1", "after1", "after2"))
    seen = with_near(lines, bucket).select(
        "rank", "line", starts(line, a1, a2).alias("first"), (starts(line, a1, a2) | starts(b1, line, a1) | starts(b2, b1, line)).alias("only"),
        (_fits(line, SECTION) & ~_fits(line, SYMBOL)).alias("section"),
    )
    seen, n = checkpoint(seen), _number_of(lines)
    seen = running(seen, "region", F.col("section").cast("long"), F.sum, n, bucket)
    seen = running(seen, "nth", F.col("first").cast("long"), F.sum, n, bucket)
    # how many came before this region: a region's first line is a section, which is no such symbol
    marked = checkpoint(running(seen, "past", F.when(F.col("section"), F.col("nth")), F.max, n, bucket))
    kept = marked.filter(~F.col("only") | (F.col("nth") - F.coalesce("past", F.lit(0)) <= limit)).select("region", F.col("only").cast("int").alias("stage"), "rank", "line")
    more = marked.filter("first").groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    said = F.concat(F.lit("... "), F.col("n") - limit, F.lit(" omitted; "), "n", F.lit(" symbols have only CRC changes"))
    more = more.select("region", F.lit(2).alias("stage"), F.posexplode(F.array(said, F.lit(""))).alias("rank", "line"))
    return _renumbered(kept.unionByName(more.withColumn("rank", F.col("rank").cast("long"))), ["region", "stage", "rank"], marked)


def with_symbols_grouped(lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """lines in which symbols that came or went one after another are counted and listed, those that went first, by kind."""
    one = lambda a, b: _fits(a, SYMBOL_CAME_OR_WENT) & F.coalesce(b == "", F.lit(False))
    line = F.col("line")
    seen = with_near(lines, bucket).select("rank", "line", one(line, F.col("after1")).alias("symbol"), one(F.col("before1"), line).alias("blank"))
    marked = checkpoint(running(seen, "run", (~F.col("symbol") & ~F.col("blank")).cast("long"), F.sum, _number_of(lines), bucket))
    part = lambda k: F.regexp_extract("line", SYMBOL_CAME_OR_WENT, k)
    symbols = marked.filter("symbol").select("run", F.when(part(3) == "removed", 1).otherwise(2).alias("which"), part(1).alias("kind"), "rank", part(2).alias("name"))
    groups = symbols.groupBy("run", "which", "kind").agg(F.count("*").alias("n"))
    head = F.concat("n", F.lit(" "), "kind", F.lit(" symbol(s) "), F.when(F.col("which") == 1, "removed").otherwise("added"))
    ends = groups.select("run", "which", "kind", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(2).alias("part"), F.lit("").alias("line")))).alias("x"))
    out = marked.filter("not symbol and not blank").select("run", F.lit(0).alias("which"), F.lit("").alias("kind"), F.lit(0).alias("part"), "rank", "line")
    out = out.unionByName(symbols.select("run", "which", "kind", F.lit(1).alias("part"), "rank", F.concat(F.lit("  "), "name").alias("line")))
    out = out.unionByName(ends.select("run", "which", "kind", "x.part", F.lit(0).cast("long").alias("rank"), "x.line"))
    return _renumbered(out, ["run", "which", "kind", "part", "rank"], marked)


def with_moves_merged(lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """lines in which members of one depth that follow each other and move by the same distance, and change in nothing else, are named by the first and the last."""
    inset = lambda x: F.length(F.regexp_extract(x, "^( *)", 1))
    whole = lambda x, k: F.regexp_extract(x, OFFSET_CHANGED, k).cast("long")

    def moved(a: Column, b: Column, c: Column) -> Column:
        return _fits(a, MEMBER_CHANGED) & _fits(b, OFFSET_CHANGED) & c.isNotNull() & (inset(a) + 2 == inset(b)) & F.coalesce(inset(a) >= inset(c), F.lit(False))

    line, b2, b1, a1, a2 = (F.col(c) for c in ("line", "before2", "before1", "after1", "after2"))
    move = lambda a, b: F.struct(inset(a).alias("inset"), (whole(b, 3) - whole(b, 2)).alias("by"))
    seen = with_near(lines, bucket).select(
        "rank", "line", F.when(moved(line, a1, a2), move(line, a1)).alias("move"), F.when(moved(b2, b1, line), move(b2, b1)).alias("last"), moved(b1, line, a1).alias("second"),
    )
    fresh = F.col("move").isNull() | F.col("last").isNull() | (F.col("move") != F.col("last"))
    marked = checkpoint(running(seen, "run", (~F.col("second") & fresh).cast("long"), F.sum, _number_of(lines), bucket))
    # a run is one plain line, or members that move together
    runs = marked.filter("not second").groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("rank", "line", "move")).alias("a"), F.max(F.struct("rank", "line")).alias("z"))
    member, before = (lambda c: F.regexp_extract(c, MEMBER_CHANGED, 2)), F.repeat(F.lit(" "), F.col("a.move.inset"))
    named = F.when(F.col("n") == 1, F.concat(F.lit("member "), member("a.line"))).otherwise(F.concat("n", F.lit(" members ("), member("a.line"), F.lit(" .. "), member("z.line"), F.lit(")")))
    said = F.array(F.concat(before, named, F.lit(" changed")), F.concat(before, F.lit("  offset changed by "), F.col("a.move.by").cast("string")))
    out = runs.select("run", F.posexplode(F.when(F.col("a.move").isNull(), F.array("a.line")).otherwise(said)).alias("part", "line"))
    return _renumbered(out, ["run", "part"], marked)


def _renumbered(lines: DataFrame, order: list[str], read: DataFrame) -> DataFrame:
    out = numbered(lines.withColumnRenamed("rank", "__old") if "rank" in order else lines, ["__old" if c == "rank" else c for c in order], 0, "rank").select("rank", "line")
    free(read)
    return out


def short(lines: DataFrame, limit: int, bucket: int = BUCKET) -> DataFrame:
    """(rank, line) of the short report: CRC changes up to limit, then symbols grouped, then moves merged; each reads what the one before left.

    A null line is an empty one; a table without lines stays empty.
    """
    lines = lines.select("rank", F.coalesce("line", F.lit("")).alias("line"))
    return with_moves_merged(with_symbols_grouped(without_crc_changes(lines, limit, bucket), bucket), bucket)
