import hashlib

import numpy as np

from symlattice.llm import exact_dedup as e


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, sha(t or ""), best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows), key=repr)


ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (None, "a"), (None, "only"), (6, "é" * 70_000), (7, "é" * 70_000), (8, "é" * 69_999 + "e"), (9, "a"), (9, "a"), (9, "b"), (10, "x" * 300_000), (11, "x" * 300_000), (12, "x" * 299_999 + "y")]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, sha string").repartition(3)
    return sorted((tuple(r) for r in e.exact_dedup(df, **options).collect()), key=repr)


def test_rows(spark):
    assert run(spark, ROWS) == brute(ROWS)
    assert run(spark, []) == []


def test_huge_texts_and_collisions(spark):
    assert run(spark, ROWS, huge=50_000) == brute(ROWS)
    assert run(spark, ROWS, hash_mask=2) == brute(ROWS)


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(e, "PER_SALT", 7)
    rows = [(i, f"t{i % 3 // 2}") for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_chunks_combine():
    data = np.random.default_rng(0).integers(0, 256, 200_001, dtype=np.uint8)
    for cut in (0, 1, 65_536, 131_073, 200_000):
        left, right, whole = e.fingerprint(data[:cut]), e.fingerprint(data[cut:]), e.fingerprint(data)
        for i, p in enumerate(e.PRIMES):
            assert (left[i] * pow(e.BASES[i], len(data) - cut, p) + right[i]) % p == whole[i]
            assert whole[i] == int.from_bytes(b"", "big") + eval_poly(data, e.BASES[i], p)


def eval_poly(data, b, p):
    h = 0
    for x in data.tolist():
        h = (h * b + x) % p
    return h
