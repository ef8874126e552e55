from pyspark.sql import functions as F

from symlattice.llm.learning import first_by_hash


def test_only_the_last_range_is_ranked(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 3).alias("kind"), F.xxhash64("id").alias("h"))
    want = {}
    for r in rows.collect():
        want.setdefault(r["kind"], []).append((r["h"], r["id"]))
    found = first_by_hash(rows, "id", "kind", 1200)
    assert found.columns == ["id", "kind", "h"]
    got = sorted((r["kind"], r["id"]) for r in found.collect())
    assert got == sorted((k, i) for k, v in want.items() for _, i in sorted(v)[:1200])
    # only rows of the range in which the bound is reached are ranked
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1 and "__range" in plan.split("Window [row_number")[1]
    assert sorted(r["id"] for r in first_by_hash(rows, "id", "kind", 5000).collect()) == list(range(6000))
    assert first_by_hash(rows.limit(0), "id", "kind", 5).count() == 0
