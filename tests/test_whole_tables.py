"""Queries over whole tables, without SQL, against brute force."""

from symlattice import queries as q
from symlattice.session import table
from symlattice.sources.tables import TableGraph
from tests.test_fixpoint import brute

SF = "/root/testdata/sf0.001"


def test_supplier_components(spark):
    edges = [(r["l_orderkey"] * 2, r["l_suppkey"] * 2 + 1) for r in table(spark, SF, "lineitem").collect()]
    got = {r["id"]: r["component"] for r in q.QUERIES["supplier_components"](spark, SF).collect()}
    assert got == brute(edges) and len(got) == len({x for e in edges for x in e})


def refined(nodes, edges):
    """Class of every node, by partition refinement."""
    out = {}
    for e in edges:
        out.setdefault(e["src"], []).append((e["label"], e["key"], e["dst"]))
    now, n = {x["id"]: (x["kind"], x["local"]) for x in nodes}, 0
    while len(set(now.values())) > n:
        n = len(set(now.values()))
        number = {c: i for i, c in enumerate(sorted(set(now.values()), key=repr))}
        now = {x["id"]: (x["kind"], x["local"], tuple(sorted((a, b, number[now[d]]) for a, b, d in out.get(x["id"], ())))) for x in nodes}
    return now


def test_classes_of_whole_graphs(spark):
    a, b = (TableGraph(spark, SF, v) for v in (0, 1))
    (na, ea), (nb, eb) = ((g.nodes().collect(), g.edges().collect()) for g in (a, b))
    both = refined(na + nb, ea + eb)
    want = {}
    for kind in {x["kind"] for x in na + nb}:
        x, y = ({both[r["id"]] for r in n if r["kind"] == kind} for n in (na, nb))
        want[kind] = (sum(r["kind"] == kind for r in na + nb), len(x), len(y), len(x & y))
    assert {r["kind"]: tuple(r)[1:] for r in q.QUERIES["version_classes"](spark, SF).collect()} == want and want["interface"][3] == 0
    one, keep = refined(na, ea), {}
    for i, c in one.items():
        keep[c] = min(i, keep.get(c, i))
    edges = {(keep[one[e["src"]]], e["label"], e["key"], keep[one[e["dst"]]]) for e in ea}
    got = [tuple(r) for r in q.QUERIES["dedupe_graph"](spark, SF).collect()]
    assert len(got) == len(edges) and set(got) == edges
