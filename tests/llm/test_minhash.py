import random
import re

import numpy as np
import pytest

from symlattice.llm import minhash
from symlattice.llm.queries import op9_minhash
from symlattice.session import table


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    """rows: (id, text); ids may repeat."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}
    find = lambda x: x if parent[x] == x else find(parent[x])
    at = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    seen = set()
    for ks in at.values():
        for p in ks:
            for q in ks:
                (i, a), (j, b) = sets[p], sets[q]
                if p < q and i is not None and j is not None and (p, q) not in seen:
                    seen.add((p, q))
                    if 100 * len(a & b) >= percent * len(a | b):
                        x, y = find(i), find(j)
                        parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hashes_follow_words():
    a, b, c, d = minhash.shingle_sets([b"The  quick\tBrown\nfox jumps over", b"the quick brown fox jumps over ", b"", b"one TWO"])
    assert (a == b).all() and len(a) == 2 and len(c) == 0
    assert (minhash.shingle_sets([b"x", b"one two"])[1] == d).all()
    assert len(minhash.shingle_sets(["É é".encode(), "é é".encode()])[0]) == 1
    assert minhash.shingle_sets(["É é".encode()])[0][0] != minhash.shingle_sets(["é é".encode()])[0][0]


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**64, 60_000, dtype=np.uint64))
    rng.shuffle(pool)
    chance = minhash.Collisions()
    for shared, own in ((9000, 500), (3000, 3000), (0, 8000), (40, 4)):
        a, b = np.sort(pool[: shared + own]), np.sort(np.concatenate([pool[:shared], pool[30_000 : 30_000 + own]]))
        x, y = (minhash.sketch(s)[None, :] for s in (a, b))
        n = np.array([len(a)], float)
        got, used = minhash.estimate(x, y, chance(n, n))
        true = shared / (shared + 2 * own)
        assert abs(got[0] - true) < 5 * (true * (1 - true) / used[0]) ** 0.5 + 0.02
    rest = np.array([1, 2, 3, 2**55, 2**56 - 1, 2**40 + 12345], dtype=np.uint64)
    assert (minhash.compress(rest) > 0).all() and (np.diff(minhash.compress(np.sort(rest)).astype(int)) != 0).all()


def test_edges_of_the_table(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "x y z x y z q"), (8, "x y z x y z q"), (8, "x y z x y z q"), (9, " ".join(base * 50))]
    for i in range(60):  # near copies of one original, and copies of copies
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(120)] = rng.choice(words)
        rows.append((100 + i, " ".join(edited)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(40)) + " " + " ".join(base[:30])) for i in range(30)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, regs string, component_id int").repartition(3)
    assert plain(minhash.near_dedup(df)) == brute(rows)
    assert minhash.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert plain(op9_minhash(spark, sf)) == brute(rows)


def test_chance_of_a_miss():
    assert minhash.misses(0.85) < 1e-6
