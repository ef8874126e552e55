"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share ``budget`` times all words by weight; a source is clamped at
``max_epochs`` times its own size and its excess is shared out by weight until
no source is above. Sorted by cap over weight, the clamped sources are a
prefix, so the fixpoint is a running sum over the table of sources.

A target is taken as whole repetitions of every document and a fractional one:
documents in the order of a seeded hash, up to the words that are still
wanted; the document on the edge counts with part of its words. A histogram of
the hash's leading digits finds the edge, so no source is ever sorted or summed
in one task; only the one digit group on the edge is.

Null text has size 0, a null source is a source of its own (last), a null id
hashes as ``null``. Sources without words get target 0. Rows with equal ids
are separate rows and may split an edge between them in either order. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that make a histogram's bin: 16 ** 3 bins a source.
DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights repeat along the sources by code point, null last."""
    by_source = Window.orderBy(F.asc_nulls_last("source"))
    nth = F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights)))
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("double"))
    t = t.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumns({"nth": F.row_number().over(order), "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "all_words": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    # the level if all before this one are clamped; the first source whose cap lies above it sets the level of all from there on
    t = t.withColumn("level", (F.col("all_words") * F.lit(budget) - F.col("spent")) / (F.col("all_weight") - F.col("gone")))
    t = t.withColumn("edge", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("nth", "level"))).over(every))
    free = F.coalesce(F.col("nth") >= F.col("edge.nth"), F.lit(False))
    return t.select("source", "source_size", F.when(free, F.col("edge.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out: str = "mix") -> DataFrame:
    """documents with a struct column ``out`` (a column of that name is replaced): size, source_size, target, taken (words, repeats counted) and repeats (whole documents; an edge document counts if at least half of it is taken)."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = documents.withColumn("__mix", F.struct(F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("order"), F.substring(order, 1, DIGITS).alias("bin"), F.col(source_col).alias("source")))
    bins = checkpoint(sized.groupBy(F.col("__mix.source").alias("source"), F.col("__mix.bin").alias("bin")).agg(F.sum("__mix.size").alias("words")))
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    want = F.round("target").cast("long")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")).withColumn("extra", want - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        bins.withColumn("upto", F.sum("words").over(upto)).join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
        .filter(F.col("upto") <= F.col("extra")).groupBy("source").agg(F.max(F.struct("bin", "upto")).alias("full"))
    )
    goal = goal.join(edges.withColumnRenamed("source", "edge_source"), F.col("source").eqNullSafe(F.col("edge_source")), "left")
    goal = checkpoint(goal.select(F.col("source").alias("__source"), F.struct("source_size", "target", "whole", "extra", F.coalesce("full.bin", F.lit("")).alias("full"), F.coalesce("full.upto", F.lit(0)).alias("upto")).alias("__goal")))
    # bins up to ``full`` fit whole; the next one that has documents is the edge
    nexts = bins.join(goal, F.col("source").eqNullSafe(F.col("__source"))).filter(F.col("bin") > F.col("__goal.full")).groupBy("__source", "__goal").agg(F.min("bin").alias("__edge"))
    goal = checkpoint(goal.join(nexts.select(F.col("__source").alias("__s"), "__edge"), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    rows = sized.join(goal, F.col("__mix.source").eqNullSafe(F.col("__source")))
    size, whole = F.col("__mix.size"), F.col("__goal.whole")
    on_edge = F.coalesce(F.col("__mix.bin") == F.col("__edge"), F.lit(False))
    inner = rows.filter(~on_edge).withColumn("__part", F.when(F.col("__mix.bin") <= F.col("__goal.full"), size).otherwise(F.lit(0).cast("long")))
    along = Window.partitionBy("__source").orderBy("__mix.order", F.col(id_col), F.xxhash64(text_col)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__goal.extra") - F.col("__goal.upto") - F.coalesce(F.sum(size).over(along), F.lit(0))
    edge = rows.filter(on_edge).withColumn("__part", F.greatest(F.lit(0).cast("long"), F.least(size, left)))
    full = F.col("__part") * 2 >= F.when(size > 0, size).otherwise(F.when(F.col("__mix.bin") <= F.col("__goal.full"), 0).otherwise(1))
    mixed = inner.unionByName(edge).withColumn(out, F.struct(size.alias("size"), F.col("__goal.source_size").alias("source_size"), F.col("__goal.target").alias("target"), (whole * size + F.col("__part")).alias("taken"), (whole + F.when(full, 1).otherwise(0)).cast("int").alias("repeats")))
    return mixed.drop("__mix", "__source", "__goal", "__edge", "__part")
