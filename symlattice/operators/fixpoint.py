"""Fixpoints over edge tables: every round is a join, cut off by a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.session import checkpoint, free


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of the undirected edges (a, b); component is the smallest id reachable.

    Alternates two steps until only stars are left. Large star: each node hangs
    its larger neighbours on the least id about it. Small star: each node hangs
    itself and its smaller neighbours on the least of those. Neither adds
    edges, distances shrink geometrically, and a node with very many neighbours
    is an aggregate with partial minima, never a group in memory.
    """
    a, b = edges.columns[:2]
    work = checkpoint(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x <> y").distinct())
    nodes = checkpoint(work.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    while True:
        both = work.union(work.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("least")).withColumn("least", F.least("x", "least"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
        large = checkpoint(large)  # no more rows than edges; repeats go below
        least = large.groupBy("x").agg(F.min("y").alias("least"))
        small = large.join(least, "x").filter("y <> least").select(F.col("y").alias("x"), F.col("least").alias("y"))
        before, work = work, checkpoint(small.union(least.select("x", "least")).distinct())
        free(before, large)
        # only stars: every node has one edge, and no centre has an edge of its own
        ends = work.select(F.col("x").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(work.select("y", F.lit(0), F.lit(1)))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    return nodes.join(work.select(F.col("x").alias("id"), F.col("y").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))


def chains(links: DataFrame) -> DataFrame:
    """(id, end, steps) of every id of the links (id, next), each id having one: where following them ends.

    Pointers double every round, so a chain of n links takes log n joins. Ids on
    a cycle, or leading into one, have no end and are left out.
    """
    now = checkpoint(links.select("id", F.col("next").alias("end"), F.lit(1).cast("long").alias("steps")))
    while True:
        further = now.select(F.col("id").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"))
        moved = checkpoint(now.join(further, "end", "left").select("id", F.coalesce("further", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("open")))
        free(now)
        total, open_ends = moved.count(), moved.filter("open").count()
        now = moved.select("id", "end", "steps")
        now._table_path = moved._table_path
        # whoever is still open after as many doublings as the number of ids allows is on a cycle or behind one
        if not open_ends or moved.filter("open").agg(F.min("steps")).first()[0] > total:
            return moved.filter(~F.col("open")).select("id", "end", "steps")
