import random

import pytest

from symlattice.plans.compare import Comparison, colours, reachable


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id long, kind string, name string, local string"), spark.createDataFrame(edges, "src long, label string, key string, dst long")


def rand(rng, n, at):
    nodes = [(at + i, "k", "", rng.choice("xxxy")) for i in range(n)]
    edges = [(at + i, rng.choice("ab"), str(k), at + rng.randrange(n)) for i in range(n) for k in range(rng.randint(0, 2))]
    return nodes, edges


def brute(a, b):
    (na, ea), (nb, eb) = a, b
    local = {n[0]: n[3] for n in na + nb}
    out = {}
    for s, label, key, d in ea + eb:
        out.setdefault(s, {})[label, key] = d
    seen, todo = set(), [(na[0][0], nb[0][0])]
    back, bad = {}, set()
    while todo:
        p = todo.pop()
        if p in seen:
            continue
        seen.add(p)
        x, y = out.get(p[0], {}), out.get(p[1], {})
        if local[p[0]] != local[p[1]] or x.keys() != y.keys():
            bad.add(p)
        for k in x.keys() & y.keys():
            back.setdefault((x[k], y[k]), set()).add(p)
            todo.append((x[k], y[k]))
    todo = list(bad)
    while todo:
        for p in back.get(todo.pop(), ()):
            if p not in bad:
                bad.add(p)
                todo.append(p)
    return seen, bad


@pytest.mark.parametrize("seed", range(4))
def test_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    a, b = rand(rng, 7, 0), rand(rng, 7, 100)
    if seed == 3:
        b = [(i + 100, *r) for i, *r in a[0]], [(s + 100, x, y, d + 100) for s, x, y, d in a[1]]
    (na, ea), (nb, eb) = graph(spark, *a), graph(spark, *b)
    c = Comparison((na, nb), (ea, eb), (0, 100))
    pairs, bad = brute(a, b)
    assert {tuple(r) for r in c.pairs.collect()} == pairs
    assert {tuple(r) for r in c.unequal().collect()} == bad
    assert {(r["a"], r["b"]) for r in c.outcomes().collect()} <= bad
    if seed == 3:
        assert not bad


def test_colours_and_reach(spark):
    nodes = [(i, "k", "", "x") for i in range(6)] + [(9, "k", "", "y")]
    edges = [(0, "a", "0", 1), (1, "a", "0", 0), (2, "a", "0", 2), (3, "a", "0", 4), (4, "a", "0", 9)]
    n, e = graph(spark, nodes, edges)
    found = {r["id"]: r["colour"] for r in colours(n, e).collect()}
    assert found[0] == found[1] == found[2] and len({found[i] for i in (0, 3, 4, 5, 9)}) == 5
    assert {r["id"] for r in reachable(e, spark.createDataFrame([(3,)], "id long")).collect()} == {3, 4, 9}


def test_incomparable_pairs_stop(spark):
    """Nodes of different kinds, or named kinds of different names, differ, and nothing below them is compared."""
    nodes = lambda at, kind, name: [(at, "interface", "", "{}"), (at + 1, kind, name, '{"x":"a|b"}'), (at + 2, "struct_union", "same", "{}"), (at + 3, "member", "m", "{}"), (at + 4, "typedef", "t", "null")]
    edges = lambda at: [(at, "symbol", "p", at + 1), (at, "symbol", "q", at + 4), (at + 1, "type", "", at + 2), (at + 2, "member", "m", at + 3)]
    for kind, name, below in (("struct_union", "one", True), ("struct_union", "other", False), ("primitive", "one", False)):
        a, b = graph(spark, nodes(0, "struct_union", "one"), edges(0)), graph(spark, nodes(10, kind, name), edges(10))
        c = Comparison((a[0], b[0]), (a[1], b[1]), (0, 10))
        pairs = {tuple(r) for r in c.pairs.collect()}
        assert ((2, 12) in pairs) == ((3, 13) in pairs) == below and (1, 11) in pairs and (4, 14) in pairs
        assert {tuple(r) for r in c.unequal().collect()} == (set() if below else {(0, 10), (1, 11)})
        assert {(r["label"], r["key"], r["change"]) for r in c.outcomes().collect()} == (set() if below else {("symbol", "p", "changed")})


def test_attributes_are_told_apart(spark):
    """Names that hold separators, and null against a text, are different attributes and colours."""
    from pyspark.sql import functions as F

    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, "-", "c"), (5, "a|b", "c")]
    nodes = spark.createDataFrame(rows, "id long, x string, y string").select("id", F.lit("k").alias("kind"), F.to_json(F.struct("x", "y")).alias("local"))
    found = {r["id"]: r["colour"] for r in colours(nodes, spark.createDataFrame([], "src long, label string, key string, dst long")).collect()}
    assert len(set(found.values())) == 4 and found[1] == found[5]


@pytest.mark.parametrize(("old", "new", "kind", "below"), [("POINTER", "POINTER", "pointer_reference", True), ("POINTER", "LVALUE_REFERENCE", "pointer_reference", False), ('{"kind":"STRUCT","name":"s"}', '{"kind":"STRUCT","name":"s","bytesize":4}', "struct_union", True), ('{"kind":"STRUCT","name":"s"}', '{"kind":"UNION","name":"s"}', "struct_union", False)])
def test_sorts_of_a_kind(spark, old, new, kind, below):
    """A pointer isn't compared with a reference, nor a struct with a union of its name."""
    side = lambda at, local: graph(spark, [(at, "interface", "", ""), (at + 1, kind, "s", local), (at + 2, "primitive", "int", "")], [(at, "symbol", "p", at + 1), (at + 1, "type", "", at + 2)])
    a, b = side(0, old), side(10, new)
    c = Comparison((a[0], b[0]), (a[1], b[1]), (0, 10))
    assert {tuple(r) for r in c.pairs.collect()} == {(0, 10), (1, 11)} | ({(2, 12)} if below else set())
    assert {tuple(r) for r in c.unequal().collect()} == (set() if old == new else {(0, 10), (1, 11)})


@pytest.mark.parametrize("seed", range(3))
def test_colours_of_cycles_and_ends(spark, seed):
    """Classes of random graphs, of what ends and what reaches a cycle, against plain refinement; edges to unknown nodes count for nothing."""
    rng = random.Random(seed)
    nodes = [(i, rng.choice("kq"), "", rng.choice("xxxy")) for i in range(40)]
    edges = [(i, rng.choice("ab"), rng.choice("12"), rng.randrange(i) if i < 28 else rng.randrange(40)) for i in range(1, 40) for _ in range(rng.randint(0, 3))] + [(1, "a", "1", 99), (30, "b", "1", 31), (31, "b", "1", 30)]
    now, n = {i: (k, x) for i, k, _, x in nodes}, 0
    while len(set(now.values())) > n:
        n = len(set(now.values()))
        number = {c: i for i, c in enumerate(sorted(set(now.values()), key=repr))}
        now = {i: (k, x, tuple(sorted((a, b, number[now[d]]) for s, a, b, d in edges if s == i and d in now))) for i, k, _, x in nodes}
    found = {r["id"]: r["colour"] for r in colours(*graph(spark, nodes, edges), ("kind",)).collect()}
    assert found.keys() == now.keys() and all((now[i] == now[j]) == (found[i] == found[j]) for i in now for j in now)


def test_colours_free_their_tables(spark):
    """Of the tables of a refinement only those that the result reads stay: a round's no longer."""
    import os

    from symlattice.session import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    n, e = graph(spark, [(i, "k", "", "x" if i else "y") for i in range(12)], [(i, "a", "", (i + 1) % 12) for i in range(12)])
    assert len({r["colour"] for r in colours(n, e).collect()}) == 12
    assert len([t for t in set(os.listdir(at)) - before if t.startswith("tables-")]) <= 3


def test_levels_lie_by_kind(spark):
    """Edges, pairs and matched edges lie in folders by kind, a comparison's own tables go, and ends that no node table has are never a difference by themselves."""
    import os

    from symlattice.session import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    nodes = lambda at: [(at, "interface", "", "{}"), (at + 1, "typedef", "t", "t"), (at + 2, "member", "m", "{}")]
    a, b = graph(spark, nodes(0), [(0, "x", "", 1), (1, "x", "", 2), (2, "x", "", 5)]), graph(spark, nodes(10), [(10, "x", "", 11), (11, "x", "", 12), (12, "x", "", 15), (11, "y", "", 12)])
    c = Comparison((a[0], b[0]), (a[1], b[1]), (0, 10))
    left = [t for t in set(os.listdir(at)) - before if t.startswith("tables-")]
    assert len(left) == 9 and any(f.startswith("of=of") for t in left for f in os.listdir(f"{at}/{t}"))
    assert {tuple(r) for r in c.unequal_of().collect()} == {(0, 10, "of interface"), (1, 11, "of typedef")}
    d = Comparison((a[0], a[0]), (a[1], a[1]), (0, 1))
    assert {tuple(r) for r in d.unequal().collect()} == {(0, 1)} and d.outcomes().count() == 0
