"""Two orders made one: what is new in the second goes where the second has it, as far as the first allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(df: DataFrame, by: list[str], first: str, second: str, rank: str = "rank") -> DataFrame:
    """df with the place, from 0, of each row of its group.

    first, second: a row's positions in two orders, at least one not null. Rows
    of the first keep its order. Read in the second order, a row that lies
    behind all earlier ones in the first too moves the place to just behind it,
    and others that the first has don't; a new row goes to the place, behind the
    new ones that are there. The place is thus a running maximum of first
    positions, and a group is sorted twice, not searched for every row.
    """
    read = Window.partitionBy(*by).orderBy(F.col(second).asc_nulls_last())
    place = F.max(F.when(F.col(second).isNotNull(), F.col(first))).over(read.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col(first).isNull()
    # null comes first: before every row of the first order
    keyed = df.withColumn("__place", F.when(new, place).otherwise(F.col(first))).withColumn("__new", new)
    order = Window.partitionBy(*by).orderBy(F.col("__place").asc_nulls_first(), "__new", second)
    return keyed.withColumn(rank, F.row_number().over(order).cast("long") - 1).drop("__place", "__new")
