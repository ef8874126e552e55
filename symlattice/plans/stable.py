"""Stable 32-bit ids of nodes of every kind: they depend on names and shapes, not on numbering or on what a name stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.functions.hashing import decayed, decayed_all, flag, fnv1a, fnv1a_of, hex32, small, together, u64, u64_of
from symlattice.plans.bottomup import evaluate
from symlattice.session import checkpoint

#: How many bits a hash of a part is decayed by, and the letters and numbers that tell kinds apart; fixed values.
SPECIAL = {"VOID": "void", "VARIADIC": "variadic", "NULLPTR": "nullptr"}
POINTERS, QUALIFIERS, INHERITANCE, STRUCTS = ("*", "&", "&&"), ("const", "volatile", "restrict", "atomic"), ("NON_VIRTUAL", "VIRTUAL"), ("struct", "union")


def stops() -> Column:
    """Whether a node's id ends at the node: named types, methods and symbols hash by name alone."""
    return F.col("kind").isin("typedef", "enum", "method", "symbol", "interface") | ((F.col("kind") == "struct") & ((F.col("name") != "") | ~F.col("defined")))


def dependencies(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, label, pos, dst): what ids are made of, but for the ends (id)."""
    made = edges.filter(F.col("label").isin("pointee", "containing", "qualified", "element", "type", "member", "method", "return", "parameter"))
    made = checkpoint(made.select("src", "label", "pos", "dst"))  # else all that edges derive from is planned with each join
    return made.join(ends.select(F.col("id").alias("src")), "src", "left_anti")


def _hashes() -> list[Column]:
    """The hashes of a node's own columns."""
    special = F.create_map(*(F.lit(x) for kv in SPECIAL.items() for x in kv))
    texts = {"hash": F.col("name"), "hash_attrs": F.col("attrs"), "hash_special": special[F.col("tag")], "hash_version": F.ltrim("text", F.lit("@"))}
    return [fnv1a_of(x).alias(k) for k, x in texts.items()] + [u64_of(c).alias(f"hash_{c}") for c in ("size", "bits")]


def _own() -> Column:
    """What a node's hash takes from the node alone, of its hashes: all of it where nothing is below."""
    c = F.col
    at = lambda column, names: F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), small(i))))[column]
    enumerators = F.transform(F.filter(F.split("text", ", "), lambda x: x != ""), lambda x: together(fnv1a(F.split(x, " = ")[0]), u64(F.split(x, " = ")[1].cast("long"))))
    enum = together(small("e"), c("hash"), flag(c("defined")))
    symbol, version = together(small("s"), c("hash")), together(c("hash_version"), flag(c("text").startswith("@@")))
    return (
        F.when(c("kind") == "special", c("hash_special"))
        .when(c("kind") == "pointer", together(small("r"), at(c("tag"), POINTERS)))
        .when(c("kind") == "typedef", together(small("t"), c("hash")))
        .when(c("kind") == "qualified", together(small("q"), at(c("tag"), QUALIFIERS)))
        .when(c("kind") == "primitive", together(small("p"), c("hash")))
        .when(c("kind") == "array", together(small("a"), c("hash_size")))
        .when(c("kind") == "base_class", together(small("b"), at(c("attrs"), INHERITANCE)))
        .when(c("kind") == "method", c("hash_attrs"))
        .when(c("kind") == "member", decayed(together(small("m"), c("hash"), c("hash_bits")), c("hash_size"), 20))
        .when(c("kind") == "struct", together(small("S"), at(c("tag"), STRUCTS), c("hash"), flag(c("defined"))))
        .when(c("kind") == "enum", F.when((c("name") != "") | ~c("defined"), enum).otherwise(decayed(enum, decayed_all(enumerators, 8), 2)))
        .when(c("kind") == "symbol", F.when(c("text") == "", symbol).otherwise(decayed(symbol, version, 16)))
        .when(c("kind") == "interface", fnv1a(F.lit("interface")))
    )


def _hashed(parts: Column | None) -> Column:
    c = F.col
    if parts is None:
        parts = F.filter(F.array(F.struct(F.lit("").alias("label"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("dst"), F.lit(0).cast("long").alias("value"))), lambda x: F.lit(False))
    every = lambda label: F.transform(F.filter(parts, lambda x: x["label"] == label), lambda x: x["value"])
    of = lambda label: F.get(every(label), F.lit(0))
    return (
        F.when(c("kind") == "pointer", decayed(c("own"), of("pointee"), 2))
        .when(c("kind") == "pointer_to_member", decayed(together(small("n"), of("containing")), of("pointee"), 16))
        .when(c("kind") == "qualified", decayed(c("own"), of("qualified"), 2))
        .when(c("kind") == "array", decayed(c("own"), of("element"), 2))
        .when(c("kind") == "base_class", decayed(c("own"), of("type"), 2))
        .when((c("kind") == "member") & c("nameless"), decayed(c("own"), of("type"), 2))
        .when(c("kind") == "member", decayed(c("own"), of("type"), 8))
        .when((c("kind") == "struct") & c("nameless") & c("defined"), decayed(c("own"), decayed_all(every("method"), 8).bitwiseXOR(decayed_all(every("member"), 8)), 2))
        .when(c("kind") == "function", decayed(together(small("f"), of("return")), decayed_all(every("parameter"), 4), 2))
        .otherwise(c("own"))
    )


def stable_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, hash, hash_id) of every typed node. A struct without a name that holds itself counts as 0 within."""
    # by themselves first, once: rounds then only combine, and carry no names
    hashed = nodes.select("*", *_hashes())
    own = checkpoint(hashed.select("id", "kind", (F.col("name") == "").alias("nameless"), "defined", stops().alias("stops"), _own().alias("own")))
    found = evaluate(own, dependencies(own.filter("stops"), edges), _hashed, F.lit(0).cast("long"), F.col("kind") == "struct", ("kind",))
    return found.select("id", "kind", F.col("value").alias("hash"), hex32(F.col("value")).alias("hash_id"))
