from pyspark.sql import functions as F

from symlattice.functions.hashing import fnv1a, fnv1a_of, u64, u64_of
from symlattice.plans.bottomup import evaluate


def test_hashes_of_columns(spark):
    """Hashes over whole columns are those of the expressions, for texts of any length, null and numbers of any sign."""
    texts = [None, "", "a", "ä€😀", "part_12", "x" * 300, *(f"l_{i}" for i in range(40))]
    numbers = [None, 0, 1, -1, 2**63 - 1, -(2**63), 2**32, *range(100, 139)]
    df = spark.createDataFrame(list(zip(texts, numbers, strict=False)), "t string, n long").repartition(3)
    rows = df.select("n", fnv1a("t").alias("f"), fnv1a_of("t").alias("g"), u64(F.col("n")).alias("u"), u64_of("n").alias("v")).collect()
    assert all(r["f"] == r["g"] and r["u"] == r["v"] for r in rows) and len(rows) == len(numbers)


def test_carries_only_what_waits(spark):
    """A node with early and late parts waits for both; nodes need no kind; columns are kept; a cycle gets its provisional value."""
    nodes = [(i, k) for i, k in enumerate("aabbccdd")]
    deps = [(2, "x", 0, 0), (3, "x", 0, 2), (3, "x", 1, 1), (4, "y", 0, 3), (4, "x", 0, 0), (5, "x", 0, 6), (6, "x", 0, 5), (7, "x", 0, 6)]
    value = lambda parts: F.lit("o") if parts is None else F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: p["value"]), ""), F.lit(")"))
    d = spark.createDataFrame(deps, "src long, label string, pos long, dst long")
    want = {0: "o", 1: "o", 2: "(o)", 3: "((o)o)", 4: "(o((o)o))", 5: "((#))", 6: "(#)", 7: "((#))"}
    for columns, keep in (("id long, kind string", ("kind",)), ("id long, other string", ("other",))):
        got = evaluate(spark.createDataFrame(nodes, columns), d, value, F.lit("#"), F.col("id") == 5, keep)
        assert {r["id"]: r["value"] for r in got.collect()} == want
        assert {(r["id"], r[keep[0]]) for r in got.collect()} == set(nodes)
