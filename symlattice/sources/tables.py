"""Two versions of an interface graph derived from the relational tables.

Customers are exported symbols, each with a function type whose parameters
point to the structs of that customer's orders; line items are members, parts
are typedefs of primitives, regions are enumerations of nations. Version 1
applies modular edits. Everything is a narrow projection of one table, so
filters and column pruning reach the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlattice.session import checkpoint, table

#: Number of each node kind; ids of a kind lie in a range of their own.
KINDS = {"pointer_reference": 2, "typedef": 4, "qualified": 5, "primitive": 6, "member": 10, "struct_union": 11, "enumeration": 12, "function": 13, "elf_symbol": 14, "interface": 15}
KIND_RANGE, VERSION_RANGE = 10**12, 5 * 10**11


def node_id(kind: str, version: int, key: Column) -> Column:
    return (F.lit(KINDS[kind] * KIND_RANGE + version * VERSION_RANGE) + key).cast("long")


@dataclass
class TableGraph:
    """The node tables of one version, by kind."""

    spark: SparkSession
    sf_dir: str
    version: int
    kept: DataFrame | None = None

    def _read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def symbols(self) -> DataFrame:
        key, v = F.col("c_custkey"), self.version
        gone = key % 97 == 5 if v == 0 else key % 89 == 7
        crc = (key % 65536) * 40503 + F.floor(key / 65536)
        return self._read("customer").filter(~gone).select(
            node_id("elf_symbol", v, key).alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("is_defined"), F.lit("FUNCTION").alias("symbol_type"),
            F.when((key % 53 == 0) & F.lit(v == 1), "WEAK").otherwise("GLOBAL").alias("binding"), F.lit("DEFAULT").alias("visibility"),
            F.when((key % 41 == 0) & F.lit(v == 1), crc + 1).otherwise(crc).cast("long").alias("crc"), F.lit(None).cast("string").alias("ns"), node_id("function", v, key).alias("type_id"),
        )

    def functions(self) -> DataFrame:
        return self._read("customer").select(node_id("function", self.version, F.col("c_custkey")).alias("id"), node_id("primitive", self.version, F.col("c_nationkey") + 1000).alias("return_type_id"))

    def parameters(self) -> DataFrame:
        """(function_id, pos, type_id): pointers to a customer's orders, in order of key; version 1 lacks some."""
        w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        rows = self._read("orders").select("o_custkey", "o_orderkey")
        rows = rows.filter("o_orderkey % 73 <> 3") if self.version else rows
        return rows.select(node_id("function", self.version, F.col("o_custkey")).alias("function_id"), F.row_number().over(w).cast("long").alias("pos"), node_id("pointer_reference", self.version, F.col("o_orderkey")).alias("type_id"))

    def pointers(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self._read("orders").select(node_id("pointer_reference", self.version, key).alias("id"), F.lit("POINTER").alias("kind"), node_id("struct_union", self.version, key).alias("pointee_type_id"))

    def structs(self) -> DataFrame:
        """bytesize is null for a struct that is only declared."""
        sizes = self._read("lineitem").groupBy("l_orderkey").agg((F.count("*") * 8).alias("size"))
        key = F.col("o_orderkey")
        declared = key % 61 == 0 if self.version == 0 else key % 67 == 0
        return self._read("orders").select("o_orderkey").join(sizes, key == F.col("l_orderkey"), "left").select(node_id("struct_union", self.version, key).alias("id"), F.lit("STRUCT").alias("kind"), F.concat(F.lit("order_"), key.cast("string")).alias("name"), F.when(~declared, F.coalesce("size", F.lit(0))).cast("long").alias("bytesize"))

    def members(self) -> DataFrame:
        """(id, struct_id, pos, name, offset, type_id) of every line item, also those of structs that are only declared."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
        key, moved = F.col("l_orderkey"), F.lit(64 if self.version == 1 else 0)
        rows = self._read("lineitem").select("l_orderkey", *order).withColumn("pos", pos)
        return rows.select(node_id("member", self.version, key * 64 + F.col("pos")).alias("id"), node_id("struct_union", self.version, key).alias("struct_id"), "pos", F.concat(F.lit("l_"), F.col("l_linenumber").cast("string")).alias("name"), ((F.col("l_linenumber") - 1) * 64 + F.when(key % 31 == 0, moved).otherwise(0)).cast("long").alias("offset"), node_id("typedef", self.version, F.col("l_partkey")).alias("type_id"))

    def _members(self) -> DataFrame:
        """members() as a table: nodes and edges need it three times."""
        if self.kept is None:
            self.kept = checkpoint(self.members())
        return self.kept

    def primitives(self) -> DataFrame:
        """Part types by rank, then nations; version 1 widens the first part type."""
        kinds = self._read("part").select("p_type").distinct().withColumn("rank", F.row_number().over(Window.orderBy("p_type")).cast("long"))  # a handful of types
        wider = F.lit(1 if self.version == 1 else 0)
        types = kinds.select(node_id("primitive", self.version, F.col("rank")).alias("id"), F.col("p_type").alias("name"), (F.lit(4) + F.when(F.col("rank") == 1, wider).otherwise(0) * 4).cast("long").alias("bytesize"))
        nations = self._read("nation").select(node_id("primitive", self.version, F.col("n_nationkey") + 1000).alias("id"), F.concat(F.lit("nation "), "n_name").alias("name"), F.lit(8).cast("long").alias("bytesize"))
        return types.unionByName(nations)

    def typedefs(self) -> DataFrame:
        names = self._read("part").select("p_partkey", "p_type")
        kinds = names.select("p_type").distinct().withColumn("rank", F.row_number().over(Window.orderBy("p_type")).cast("long"))
        return names.join(kinds, "p_type").select(node_id("typedef", self.version, F.col("p_partkey")).alias("id"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), node_id("primitive", self.version, F.col("rank")).alias("referred_type_id"))

    def qualifiers(self) -> DataFrame:
        """(id, qualifier, next): chains of qualified types over a part's typedef, by its size; version 1 shifts the sizes."""
        size = F.col("p_size") + self.version
        held = F.filter(F.array(F.when(size % 2 == 0, "const"), F.when(size % 3 == 0, "volatile"), F.when(size % 5 == 0, "restrict")), lambda q: q.isNotNull())
        each = self._read("part").select("p_partkey", held.alias("held")).select("p_partkey", "held", F.posexplode("held").alias("at", "qualifier"))
        here = lambda n: node_id("qualified", self.version, F.col("p_partkey") * 4 + n)
        return each.select(here(F.col("at")).alias("id"), "qualifier", F.when(F.col("at") + 1 < F.size("held"), here(F.col("at") + 1)).otherwise(node_id("typedef", self.version, F.col("p_partkey"))).alias("next"))

    def aliases(self) -> DataFrame:
        """(id, name, next): typedefs of typedefs, part k of part k // 4; version 1 points every seventh at its predecessor instead. Part 0 is a primitive's."""
        key, v = F.col("p_partkey"), self.version
        to = F.when(F.lit(v == 1) & (key % 7 == 0), key - 1).otherwise(F.floor(key / 4))
        return self._read("part").filter("p_partkey > 0").select(node_id("typedef", v, key).alias("id"), F.concat(F.lit("part_"), key.cast("string")).alias("name"), node_id("typedef", v, to).alias("next"))

    def enumerators(self) -> DataFrame:
        """(enum_id, enum_name, pos, name, value); version 1 renames nation 3 and drops nation 7."""
        rows = self._read("region").join(self._read("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
        rows = rows.filter(F.col("n_nationkey") != 7) if self.version else rows
        name = F.when((F.col("n_nationkey") == 3) & F.lit(self.version == 1), F.concat("n_name", F.lit("_NEW"))).otherwise(F.col("n_name"))
        pos = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey")).cast("long")
        return rows.select(node_id("enumeration", self.version, F.col("r_regionkey")).alias("enum_id"), F.col("r_name").alias("enum_name"), pos.alias("pos"), name.alias("name"), F.col("n_nationkey").cast("long").alias("value"))

    def nodes(self) -> DataFrame:
        """(id, kind, name, local): ``local`` is everything that is compared in the node itself, as JSON, which tells null from any text."""
        text = lambda *cs: F.to_json(F.struct(*cs))
        of = lambda df, kind, name, local: df.select("id", F.lit(kind).alias("kind"), name.alias("name"), local.alias("local"))
        none = F.lit("")
        parts = [
            of(self.symbols(), "elf_symbol", F.col("name"), text("name", "is_defined", "symbol_type", "binding", "visibility", "crc", "ns")),
            of(self.functions(), "function", none, none),
            of(self.pointers(), "pointer_reference", none, F.col("kind")),
            of(self.structs(), "struct_union", F.col("name"), text("kind", "name", "bytesize")),
            of(self._members(), "member", F.col("name"), text("name", "offset")),
            of(self.typedefs(), "typedef", F.col("name"), F.col("name")),
            of(self.primitives(), "primitive", F.col("name"), text("name", "bytesize")),
            self.spark.range(1).select(node_id("interface", self.version, F.lit(0)).alias("id"), F.lit("interface").alias("kind"), F.lit("").alias("name"), F.lit("").alias("local")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def edges(self) -> DataFrame:
        """(src, label, key, dst): key matches edges of two versions; repeated names count their occurrences."""
        one = lambda df, src, label, dst: df.select(F.col(src).alias("src"), F.lit(label).alias("label"), F.lit("").alias("key"), F.col(dst).alias("dst"))
        occurrence = F.row_number().over(Window.partitionBy("struct_id", "name").orderBy("pos"))
        whole = self.structs().filter("bytesize is not null").select(F.col("id").alias("struct_id"))
        parts = [
            self.symbols().select(node_id("interface", self.version, F.lit(0)).alias("src"), F.lit("symbol").alias("label"), F.col("name").alias("key"), F.col("id").alias("dst")),
            one(self.symbols(), "id", "type", "type_id"),
            one(self.functions(), "id", "return", "return_type_id"),
            self.parameters().select(F.col("function_id").alias("src"), F.lit("parameter").alias("label"), F.col("pos").cast("string").alias("key"), F.col("type_id").alias("dst")),
            one(self.pointers(), "id", "pointee", "pointee_type_id"),
            self._members().join(whole, "struct_id", "left_semi").select(F.col("struct_id").alias("src"), F.lit("member").alias("label"), F.concat_ws("#", "name", occurrence.cast("string")).alias("key"), F.col("id").alias("dst")),
            one(self._members(), "id", "type", "type_id"),
            one(self.typedefs(), "id", "referred", "referred_type_id"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
