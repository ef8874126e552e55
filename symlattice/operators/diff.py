"""Matching and difference operators over node tables of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match(old: DataFrame, new: DataFrame, keys: list[str], ignore_added: bool = False) -> DataFrame:
    """Full outer match on keys; the other columns come back as structs ``old`` and ``new``, null on the missing side.

    Without additions it is a left join, so unmatched rows of the new side never leave their scan's shuffle.
    """
    side = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))
    return side(old, "old").join(side(new, "new"), keys, "left" if ignore_added else "full_outer")


def status(changed: Column) -> Column:
    return F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(changed, "changed").otherwise("same")


def changed_from_to(what: str, old: Column, new: Column) -> Column:
    """``X changed from A to B``; for optional values ``X A was removed`` or ``X B was added``."""
    return F.when(old.isNull() & new.isNotNull(), F.concat(F.lit(f"{what} "), new, F.lit(" was added"))).when(old.isNotNull() & new.isNull(), F.concat(F.lit(f"{what} "), old, F.lit(" was removed"))).when(old != new, F.concat(F.lit(f"{what} changed from "), old, F.lit(" to "), new))


def occurrence(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with ``nth``: repeated keys are told apart by their position, so that they match positionally."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: consecutive rows with the same value, as (by..., value, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.col(order) == F.lag(order).over(w) + 1), 0).otherwise(1)
    islands = df.withColumn("__start", starts).withColumn("__island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__island")


def top_with_rest(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows by order, and how many more there are, without sorting all of them: only the limit's rows and one count move."""
    head = df.orderBy(order).limit(limit).select(order, F.lit(None).cast("long").alias("omitted"))
    return head.unionByName(df.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted")).select(F.lit(None).cast("string").alias(order), "omitted").filter("omitted > 0"))


def transitions(old: DataFrame, new: DataFrame, key: str, level: str) -> DataFrame:
    """(before, after, n, least, greatest) over the full outer match of two level maps, absence being level 0."""
    both = old.select(key, F.col(level).alias("before")).join(new.select(key, F.col(level).alias("after")), key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.groupBy("before", "after").agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("greatest"))


#: What a comparison can be told to ignore; fixed values of the survey.
IGNORES = ("type_declaration_status", "symbol_type_presence", "primitive_type_encoding", "member_size", "enum_underlying_type", "qualifier", "linux_symbol_crc", "interface_addition", "type_definition_addition")


def heeded(what: Column, added: Column, ignore: set[str]) -> Column:
    """Whether a difference counts. what: the flag that covers its kind, or null; added: whether only the new side is there, or is defined."""
    if unknown := ignore - set(IGNORES):
        raise ValueError(f"no such ignore: {sorted(unknown)}")
    gone = F.lit(False)
    for name in sorted(ignore):
        covered = what == ("type_declaration_status" if name == "type_definition_addition" else name)
        gone = gone | (covered & added if name.endswith("_addition") else covered)
    return ~F.coalesce(gone, F.lit(False))


def set_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str, what: str) -> DataFrame:
    """(keys..., value, text) of the members that one of two sets (keys, value) lacks, among keys that both have."""
    both = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys)
    mark = lambda df, name: df.filter(F.col(value).isNotNull()).select(*keys, value, F.lit(True).alias(name)).distinct()
    found = mark(old, "__old").join(mark(new, "__new"), [*keys, value], "full_outer").filter("__old is null or __new is null").join(both, keys, "left_semi")
    return found.select(*keys, value, F.concat(F.lit(f"{what} "), F.col(value), F.when(F.col("__new").isNull(), " removed").otherwise(" added")).alias("text"))


def anonymous_keys(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """df with empty keys numbered ``#anon#n`` from 0 in order, among the empty ones of each group."""
    nth = F.row_number().over(Window.partitionBy(*by, F.col(key) == "").orderBy(*order)) - 1
    return df.withColumn(key, F.when(F.col(key) == "", F.concat(F.lit("#anon#"), nth.cast("string"))).otherwise(F.col(key)))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (src, label, key, dst) with both ends replaced as (id, to) says, each once; ends that it doesn't name stay."""
    for end in ("src", "dst"):
        edges = edges.join(mapping.select(F.col("id").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.select("src", "label", "key", "dst").distinct()
