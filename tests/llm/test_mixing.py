import re
from collections import defaultdict

from symlattice.llm import mixing
from symlattice.llm.mixing import mix
from symlattice.llm.queries import op8_mix


def fixpoint(sizes, weights, budget, most):
    """Water-filling by rounds, as one would by hand."""
    total = budget * sum(sizes.values())
    held, free = {}, set(sizes)
    while True:
        rest, w = total - sum(held.values()), sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > most * sizes[s] + 1e-9} if w else set()
        if not over:
            return held | {s: rest * weights[s] / w for s in free}
        held |= {s: most * sizes[s] for s in over}
        free -= over


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string").repartition(3)
    return [(r["doc_id"], r["source"], *r["mix"]) for r in mix(df, **options).collect()]


def check(rows, got):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    assert len(got) == len(rows)
    for _, source, size, _, goal, words, repeats in got:
        sizes[source] += size
        taken[source] += words
        target[source] = goal
        assert 0 <= words <= 2 * size and 0 <= repeats <= 2
    assert sorted(g[2] for g in got) == sorted(len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = fixpoint(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 1


def test_sources(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(200)]
    rows += [(1000, "x " * 5000, "s0"), (1001, None, None), (1002, "a b c", None), (1003, "", "empty"), (None, "null id here", "s1"), (5, "again", "s1"), (5, "again", "s1"), (1004, " xy\x1fz", "É"), (1005, "one", "Z")]
    got = run(spark, rows)
    check(rows, got)
    assert sorted(map(repr, got)) == sorted(map(repr, run(spark, rows)))
    assert run(spark, []) == []
    check(rows[:1], run(spark, [(0, "", "s0")]))


def test_native_plan(spark, capsys):
    op8_mix(spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_repeated_ids_and_clashing_names(spark):
    """Rows of one id and different texts on the edge are cut in one order, and a column of the caller's stays."""
    rows = [(7, "a b c", "s", "x"), (7, "d", "s", "y"), (7, "e f", "s", "z"), (8, "g", "t", "m")]
    runs = []
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix string").repartition(parts)
        got = mixing.mix(df, out="outcome").select("text", "mix", "outcome.taken").collect()
        assert {r["text"]: r["mix"] for r in got} == {t: m for _, t, _, m in rows}
        runs.append(sorted(map(tuple, got)))
    assert runs[0] == runs[1]
