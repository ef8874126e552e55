import random

from symlattice.operators.fixpoint import components


def brute(edges):
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5000 + i, 4000) for i in range(300)]
    some = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    edges = [*chain, *star, *some, *chain[:5]]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
