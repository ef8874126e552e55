"""What the trained operators share: who may be learnt from, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.session import checkpoint, slim


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def held_out(id_col: str) -> Column:
    """Rows that nothing may be learnt from; null ids aren't learnt from either, but count as not held out."""
    return F.coalesce(remainder(id_col) == 1, F.lit(False))


#: Leading bits of the hash by which rows are counted to find where each value's share ends.
CUT_BITS = 10


def first_by_hash(rows: DataFrame, id_col: str, per: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``per`` (nulls aside), by the hash of the id.

    Hash ranges are counted first. Ranges below the one in which a value reaches
    ``most`` are taken whole, and only that one range is ranked, so no task sorts
    all rows of a value.
    """
    order = F.xxhash64(id_col)
    ranged = rows.withColumn("__range", F.shiftright(order, 64 - CUT_BITS))
    counts = ranged.groupBy(per, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = counts.withColumn("__before", before).filter(f"__before < {most} and __before + __n >= {most}")
    cuts = checkpoint(cuts.select(per, F.col("__range").alias("__cut"), (F.lit(most) - F.col("__before")).alias("__rest")))
    found = ranged.join(slim(cuts), per, "left").filter("__cut is null or __range <= __cut").withColumn("__hash", order)
    edge = found.filter("__range = __cut").withColumn("__nth", F.row_number().over(Window.partitionBy(per).orderBy("__hash", id_col)))
    edge = edge.filter("__nth <= __rest").drop("__nth")
    return found.filter("__cut is null or __range < __cut").unionByName(edge).select(*rows.columns)
