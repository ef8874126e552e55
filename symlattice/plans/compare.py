"""Comparison of two rooted graphs as relational fixpoints.

Pairs of nodes are expanded from the pair of roots by matching edges on label
and key; a pair differs locally if the nodes' own attributes do or if an edge
has no partner; what reaches a local difference is unequal. Nodes of different
kinds, of named kinds with different names, a pointer and a reference, or a
struct and a union are incomparable: their pair differs and nothing below it is
compared. That is free of any traversal order,
so cycles need no component finder. Every level is a table of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.session import checkpoint, free

#: Kinds whose nodes are comparable only under one name.
NAMED = ("primitive", "struct_union", "enumeration")


def _tag() -> Column:
    """What two nodes must share to be comparable: their kind, the name of a named kind, the sort of a pointer, and whether it is a struct or a union."""
    sort = F.when(F.col("kind") == "pointer_reference", F.col("local")).when(F.col("kind") == "struct_union", F.get_json_object("local", "$.kind"))
    return F.struct("kind", F.when(F.col("kind").isin(*NAMED), F.col("name")).alias("name"), sort.alias("sort"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the nodes reached from roots (id), by frontier joins."""
    edges = checkpoint(edges.select("src", "dst").distinct())
    levels = [checkpoint(roots.select("id").distinct())]
    while not levels[-1].isEmpty():
        step = edges.join(levels[-1].withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        levels.append(checkpoint(step.join(union(levels), "id", "left_anti")))
    return union(levels)


def _of(kind: Column) -> Column:
    """The folder of a kind: none has an empty name."""
    return F.concat(F.lit("of "), F.coalesce(kind, F.lit("")))


def _folders(df: DataFrame, name: str = "of") -> list[str]:
    return [r[0] for r in df.select(name).distinct().collect()]  # a handful


class Comparison:
    """The pairs, matched edges and verdicts of two graphs (nodes, edges) from their roots.

    Edges lie in folders by the kind of their source, pairs by that of their old
    node, matched edges by that of their old end: a level reads those of the kinds
    that it is about. What a pair needs of its nodes comes along with the edge to it.
    """

    def __init__(self, nodes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame], roots: tuple[int, int]):
        # tag is what makes nodes comparable; kept for the edges only
        ends = [checkpoint(n.select("id", "kind", F.struct("local", _tag().alias("tag")).alias("end"))) for n in nodes]
        self.edges = tuple(
            checkpoint(
                e.select("src", "label", "key", "dst").join(n.select(F.col("id").alias("dst"), "end"), "dst", "left")
                .join(n.select(F.col("id").alias("src"), "kind"), "src", "left").select("src", "label", "key", "dst", "end", _of(F.col("kind")).alias("of")), ["of"]
            )
            for e, n in zip(edges, ends, strict=True)
        )
        spark = nodes[0].sparkSession
        tops = [n.filter(F.col("id") == r).select(F.col("end").alias(t)) for n, r, t in zip(ends, roots, ("ea", "eb"), strict=True)]
        first = spark.range(1).select(*(F.lit(r).cast("long").alias(c) for r, c in zip(roots, "ab", strict=True))).join(tops[0], F.lit(True), "left").join(tops[1], F.lit(True), "left")  # one row each
        levels, links = [checkpoint(first.select("a", "b", *self._judged()), ["of"])], []
        free(*ends)
        while new := _folders(levels[-1].filter("comparable")):
            links.append(checkpoint(self._match(levels[-1].filter("comparable"), new), ["of"]))
            both = links[-1].filter("ca is not null and cb is not null")
            seen = union(levels).filter(F.col("of").isin(_folders(both))).select("a", "b")
            step = both.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "comparable", "known", "changed", "of").dropDuplicates(["a", "b"])
            levels.append(checkpoint(step.join(seen, ["a", "b"], "left_anti").select(*levels[0].columns), ["of"]))
        self.every = union(levels)
        self.links = union(links) if links else checkpoint(self._match(levels[0].filter("comparable"), []))
        free(*self.edges)
        self.pairs = self.every.select("a", "b")

    @staticmethod
    def _judged() -> list[Column]:
        """comparable, known, changed, of: what the ends ea and eb of a pair say; known if both nodes are there, changed if it differs by itself."""
        comparable, known = F.col("ea.tag").eqNullSafe(F.col("eb.tag")), F.col("ea").isNotNull() & F.col("eb").isNotNull()
        return [comparable.alias("comparable"), known.alias("known"), (known & (~comparable | ~F.col("ea.local").eqNullSafe(F.col("eb.local")))).alias("changed"), _of(F.col("ea.tag.kind")).alias("of")]

    def _match(self, frontier: DataFrame, kinds: list[str]) -> DataFrame:
        """(a, b, within, label, key, ca, cb, comparable, known, changed, of): the edges of each pair, full outer by label and key; within is the pair's own folder."""
        x, y = (e.filter(F.col("of").isin(kinds)).drop("of") for e in self.edges)
        by = ["a", "b", "within", "label", "key"]
        frontier = frontier.select("a", "b", F.col("of").alias("within"))
        left = frontier.join(x, F.col("a") == F.col("src")).select(*by, F.col("dst").alias("ca"), F.col("end").alias("ea"))
        right = frontier.join(y, F.col("b") == F.col("src")).select(*by, F.col("dst").alias("cb"), F.col("end").alias("eb"))
        return left.join(right, by, "full_outer").select(*by, "ca", "cb", *self._judged())

    def local(self) -> DataFrame:
        """(a, b, of) that are incomparable or differ by themselves."""
        own = self.every.filter("changed").select("a", "b", "of")
        return own.unionByName(self.links.filter("ca is null or cb is null").select("a", "b", F.col("within").alias("of"))).distinct()

    def unequal_of(self) -> DataFrame:
        """(a, b, of) from which a local difference is reachable."""
        levels = [checkpoint(self.local(), ["of"])]
        while new := _folders(levels[-1]):
            back = self.links.filter(F.col("of").isin(new) & F.col("ca").isNotNull() & F.col("cb").isNotNull()).select("a", "b", "within", "ca", "cb")
            step = back.join(levels[-1].select(F.col("a").alias("ca"), F.col("b").alias("cb")), ["ca", "cb"]).select("a", "b", F.col("within").alias("of")).distinct()
            levels.append(checkpoint(step.join(union(levels).select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "of"), ["of"]))
        return union(levels)

    def unequal(self) -> DataFrame:
        """(a, b) from which a local difference is reachable."""
        return self.unequal_of().select("a", "b")

    def outcomes(self) -> DataFrame:
        """(a, b, label, key, change): the details of every unequal pair: one-sided edges, and edges to unequal pairs."""
        bad = self.unequal()
        ends = bad.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.lit(True).alias("differs"))
        change = F.when(F.col("cb").isNull(), "removed").when(F.col("ca").isNull(), "added").when(F.col("differs"), "changed")
        return self.links.join(bad, ["a", "b"], "left_semi").join(ends, ["ca", "cb"], "left").select("a", "b", "label", "key", change.alias("change")).filter("change is not null")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(node, holds, changed) and (src, key, dst) of the difference graph: nodes are unequal pairs as ``a:b``; dst is null for what only one side has.

        Comparable named types and the interface hold changes; a pair that is incomparable, or differs by its own attributes, changes by itself.
        """
        bad = checkpoint(self.unequal())
        pair = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
        found = self.every.filter("known").join(bad, ["a", "b"], "left_semi")
        holds = F.col("comparable") & F.col("of").isin(*(f"of {k}" for k in (*NAMED, "typedef", "interface")))
        nodes = found.select(pair("a", "b").alias("node"), holds.alias("holds"), "changed")
        ends = bad.select(F.col("a").alias("ca"), F.col("b").alias("cb"), pair("a", "b").alias("dst"))
        links = self.links.join(bad, ["a", "b"], "left_semi").join(ends, ["ca", "cb"], "left").filter("dst is not null or ca is null or cb is null")
        return nodes, links.select(pair("a", "b").alias("src"), F.concat_ws("/", "label", "key").alias("key"), "dst")


#: Parts of a hash that add up over edges: halves of 128 bits, so that sums are free of order and don't overflow below 2**31 edges.
HALVES = tuple(f"h{i}" for i in range(4))


def _halves(*columns: str) -> list[Column]:
    hashes = [F.xxhash64(F.lit(k), *columns, F.lit(k)) for k in (0, 1)]
    return [h.alias(name) for name, h in zip(HALVES, (y for x in hashes for y in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))), strict=True)]


def _colour(*columns: str) -> Column:
    """128 bits of columns as two longs: a quarter of what a digest takes as text."""
    return F.struct(F.xxhash64(F.lit(0), *columns).alias("x"), F.xxhash64(F.lit(1), *columns, F.lit(1)).alias("y")).alias("colour")


def colours(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, colour, and the columns to keep): classes of nodes that no sequence of edges tells apart.

    A colour is made of a node's own columns and of its edges with the colours
    that they lead to. Nodes all of whose ends have their colour get theirs for
    good, level by level, so that every edge is joined once; edges lie in folders
    by the kind of their end, and a round reads those of the kinds that just got
    colours. What reaches a cycle is left and refined in rounds, until the number
    of its classes stands still: it is in no class with the rest, which ends.
    """
    base = nodes.select("id", "kind", *(c for c in keep if c != "kind"), _colour("kind", "local", F.isnull("kind"), F.isnull("local")).alias("own"))
    base = checkpoint(base)
    ends = edges.select("src", "label", "key", "dst").join(base.select(F.col("id").alias("dst"), _of(F.col("kind")).alias("of")), "dst")
    links = ends.select(F.col("src").alias("id"), F.xxhash64("label", "key", F.isnull("label"), F.isnull("key")).alias("edge"), "dst", "of")
    # rows without an edge are nodes without one
    links = base.join(links, "id", "left").withColumn("n", F.count("dst").over(Window.partitionBy("id"))).withColumn("of", F.coalesce("of", F.lit("leaf")))
    own = [c for c in base.columns if c != "id"]
    links = checkpoint(links.select("id", *own, "n", "edge", "dst", "of"), ["of"])
    total = base.count()
    free(base)
    out = ["id", *dict.fromkeys(["kind", *keep])]
    made = _colour("own.x", "own.y", "n", *HALVES)
    done = [checkpoint(links.filter("of = 'leaf'").select("*", *(F.lit(0).cast("long").alias(h) for h in HALVES)).select(*out, made))]
    settled, waiting = done[0].count(), None
    carried = ["id", *own, "n"]
    sums = [F.sum(h).alias(h) for h in HALVES]
    kinds = lambda df: [f"of {r[0] or ''}" for r in df.select("kind").distinct().collect()]  # noqa: E731  a handful
    while new := kinds(done[-1]):
        met = links.filter(F.col("of").isin(new)).join(done[-1].select(F.col("id").alias("dst"), "colour"), "dst")
        met = met.select(*carried, F.lit(1).cast("long").alias("met"), *_halves("edge", "colour.x", "colour.y"))
        # a node with a single edge needs no others: no shuffle
        single, many = met.filter("n = 1"), met.filter("n > 1")
        if waiting is not None:
            many = many.unionByName(waiting)
        grouped = checkpoint(single.unionByName(many.groupBy(*carried).agg(F.sum("met").alias("met"), *sums)))
        done.append(checkpoint(grouped.filter("met = n").select(*out, made)))
        settled += done[-1].count()
        if waiting is not None:
            free(held)
        held, waiting = grouped, grouped.filter("met < n")
    found = union(done)
    if settled < total:
        found = found.unionByName(_refined(links, found, waiting, out, carried))
    if waiting is not None:
        free(held)
    free(links)
    return found.select("id", "colour", *keep)


def _refined(links: DataFrame, found: DataFrame, waiting: DataFrame | None, out: list[str], carried: list[str]) -> DataFrame:
    """Colours of the nodes that found lacks: refinement among them until the number of classes stands still."""
    left = links.join(found.select("id"), "id", "left_anti")
    edges = checkpoint(left.select("id", "edge", "dst").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    first = left.select(*carried).distinct()
    # what settled nodes gave is a part of what a node is by itself
    given = F.struct(*(F.coalesce(h, F.lit(0).cast("long")).alias(h) for h in HALVES)).alias("given")
    first = (first.join(waiting.select("id", *HALVES), "id", "left") if waiting is not None else first.select("*", *(F.lit(0).cast("long").alias(h) for h in HALVES))).select(*carried, given)
    first = checkpoint(first.select(*out, _colour("own.x", "own.y", "n", *(f"given.{h}" for h in HALVES)).alias("own")))
    now = checkpoint(first.select(*out, F.col("own").alias("colour")))
    classes = now.select("colour").distinct().count()
    while True:
        ends = edges.join(now.select(F.col("id").alias("dst"), "colour"), "dst").select("id", *_halves("edge", "colour.x", "colour.y"))
        below = ends.groupBy("id").agg(*(F.sum(h).alias(h) for h in HALVES))
        before, now = now, checkpoint(first.join(below, "id", "left").select(*out, _colour("own.x", "own.y", *(F.coalesce(h, F.lit(0).cast("long")) for h in HALVES))))
        free(before)
        count = now.select("colour").distinct().count()
        if count == classes:
            free(edges, first)
            return now
        classes = count
