import math

import numpy as np
from pyspark.sql import functions as F

from symlattice.llm.topk import top_k


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            found = sorted(((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in ok if i != q))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = [tuple(r) for r in top_k(df, F.col("id") % 100 == 0, k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ties_nulls_and_lengths(spark):
    rng = np.random.default_rng(0)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(rng.normal(size=8))) for i in range(250)]
    rows += [(1000 + i, f32([0.5] * 8)) for i in range(40)] + [(2000, f32([0.5] * 8)), (2100, [float("nan")] * 8), (2101, [float("inf")] * 8), (2200, None), (None, [1.0] * 8), (2300, []), (2400, [0.25]), (2500, [1.0, None]), (2600, [1e9] * 8), (2700, [-1e9] * 9)]
    assert run(spark, rows) == brute(rows, 10)


def test_few_candidates(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (100, [0.0, 2.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == set()
