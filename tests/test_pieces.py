import random

import pytest

from symlattice.plans.pieces import pieces


SF = "/root/testdata/sf0.001"


def read(nodes, details, root):
    """Pieces as a reader goes through them: a queue of holders, each read depth first."""
    holds, changed = {n: h for n, h, _ in nodes}, {n: c for n, _, c in nodes}
    out, queue, order = {}, [], []
    of = {}
    for s, key, d in sorted(details, key=lambda x: x[1]):
        of.setdefault(s, []).append((key, d))

    def go(piece, node, path, start):
        if holds[node] and not start:
            out[piece].setdefault((node, True), (path, False))
            if node not in order and node not in queue:
                queue.append(node)
            return False
        good = changed[node]
        mine = out[piece].setdefault((node, False), [path, False])
        for key, d in of.get(node, ()):
            good |= d is None or go(piece, d, (*path, key), False)
        mine[1] |= good
        return good

    for key, d in of.get(root, ()):
        if d is not None and holds[d]:
            if d not in queue:
                queue.append(d)
        elif d is not None and d not in order:
            order.append(d)
            out[d] = {}
    for d in list(order):
        go(d, d, (), True)
    while queue:
        d = queue.pop(0)
        order.append(d)
        out[d] = {}
        go(d, d, (), True)
    return {(order.index(p), p, n, tuple(path), stops, good) for p, rows in out.items() for (n, stops), (path, good) in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_pieces(spark, seed):
    rng = random.Random(seed)
    n = 14
    nodes = [(0, True, False)] + [(i, rng.random() < 0.4, rng.random() < 0.3) for i in range(1, n)]
    holds = {i: h for i, h, _ in nodes}
    details = [(0, f"s{i}", i) for i in rng.sample(range(1, n), 5)]
    for i in range(1, n):
        for k in range(rng.randint(0, 3)):
            d = rng.choice([None, *range(1, n)])
            if d is None or holds[d] or d > i:  # cycles pass holders only
                details.append((i, f"k{k}", d))
    df = spark.createDataFrame(nodes, "node long, holds boolean, changed boolean"), spark.createDataFrame(details, "src long, key string, dst long")
    got = {(r["rank"], r["piece"], r["node"], tuple(r["path"]), r["stops"], r["interesting"]) for r in pieces(*df, 0).collect()}
    assert got == read(nodes, details, 0) and len(got) > 5


def test_whole_comparison(spark):
    """The pieces of the derived graphs' differences, and those of one interface with itself."""
    from symlattice import queries as q

    nodes, details = (x.collect() for x in q._comparison(spark, SF).graph())
    root = f"{15 * q.KIND_RANGE}:{15 * q.KIND_RANGE + q.VERSION_RANGE}"
    want = read([tuple(x) for x in nodes], [tuple(x) for x in details], root)
    got = {(r["rank"], r["piece"], r["node"], r["path"], r["stops"], r["interesting"]) for r in q.QUERIES["report_pieces"](spark, SF).collect()}
    assert got == {(*x[:3], " ".join(x[3]), *x[4:]) for x in want} and len({x[1] for x in got}) > 100
