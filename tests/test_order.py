import random

import pytest

from symlattice.operators.order import reconcile


def fold(first, second):
    """The same by insertion, one item after another."""
    out, place = list(first), 0
    for x in second:
        if x not in out:
            out.insert(place, x)
            place += 1
        elif out.index(x) >= place:
            place = out.index(x) + 1
    return out


#: Two orders and what they give together; fixed cases.
CASES = [
    ("rose george emily", "george ted emily", "rose george ted emily"), ("", "", ""), ("a", "", "a"), ("", "a", "a"), ("a z", "", "a z"), ("", "a z", "a z"),
    ("a b c", "c d", "a b c d"), ("a b d", "b c d", "a b c d"), ("a c d", "a b c", "a b c d"), ("b c d", "a b", "a b c d"), ("a z", "z a q", "a z q"),
]


def rows(group, first, second):
    at = lambda xs, x: xs.index(x) if x in xs else None
    return [(group, x, at(first, x), at(second, x)) for x in dict.fromkeys([*second, *first])]


def found(spark, groups):
    made = [r for k, (a, b) in enumerate(groups) for r in rows(k, a, b)]
    got = reconcile(spark.createDataFrame(made, "g long, item string, a long, b long").repartition(3), ["g"], "a", "b").collect()
    out = [[None] * len({*a, *b}) for a, b in groups]
    for r in got:
        out[r["g"]][r["rank"]] = r["item"]
    return out


def test_fixed_cases(spark):
    groups = [(a.split(), b.split()) for a, b, _ in CASES]
    assert found(spark, groups) == [c.split() for _, _, c in CASES] == [fold(a, b) for a, b in groups]


def test_positions_with_gaps(spark):
    """Removed, added and kept items: positions count, not the order in which the rows come."""
    made = [(0, "emily", 20, 12), (0, "george", 11, 10), (0, "rose", 10, None), (0, "ted", None, 11)]
    got = reconcile(spark.createDataFrame(made, "g long, item string, a long, b long"), ["g"], "a", "b")
    assert [r["item"] for r in got.orderBy("rank").collect()] == ["rose", "george", "ted", "emily"]


@pytest.mark.parametrize("seed", range(2))
def test_random_orders(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.sample("abcdefgh", rng.randint(0, 8))
    groups = [(pick(), pick()) for _ in range(150)]
    assert found(spark, groups) == [fold(a, b) for a, b in groups]
