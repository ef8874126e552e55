import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symlattice.llm import spelling as s


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, length, least, times):
    n = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    forms, out = {}, {}
    for w in n:
        near = [v for v in n if one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= times * n[w] else None
        out[w] = [n[w], len(near), forms[w], n[best] if forms[w] else None]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def test_gram_matrix_against_edits():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    block = lambda ws: np.array([[*w.encode("latin-1")] for w in ws], np.uint8)
    a, b, c = ([word(n) for _ in range(80)] for n in (7, 7, 8))
    for x, y in ((a, b), (a, c)):
        i, j = s.near(block(x), block(y))
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == {(i, j) for i in range(80) for j in range(80) if one_edit(x[i], y[j])} and len(i)


@pytest.mark.parametrize("seed", range(3))
def test_variants(spark, seed, monkeypatch):
    monkeypatch.setattr(s, "SPLIT_WORDS", 3)
    rng = random.Random(seed)
    text = lambda: " ".join("".join(rng.choice("abÀé÷") for _ in range(rng.randint(3, 6))) + rng.choice(["", "X", ",", "日"]) for _ in range(40)) + " aabbab" * rng.randint(0, 30)
    docs = [(i, text()) for i in range(40)] + [(None, text()), (3, None), (5, ""), (5, "aabbab aabbab"), (5, "aabbab aabbab")]
    odd = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "part": F.lit(None)})
    got = {r["word"]: tuple(r)[1:] for r in s.variants(odd.repartition(3), 4, 2, 3).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    want = brute(docs, 4, 2, 3)
    assert got == want and any(x[2] for x in got.values())


def test_chain_of_forms_long_words_and_empty_tables(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert s.variants(docs([])).isEmpty() and s.variants(docs([(1, None), (2, "short words")])).isEmpty()
    long = "ab" * 3000
    rows = [(k, w) for k, w in enumerate(["corpora "] * 400 + ["corporax "] * 30 + ["corporaxy "] * 2 + [f"{long} "] * 30 + [f"{long}c "] * 2)]
    got = {r["word"]: tuple(r)[1:] for r in s.variants(docs(rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == brute(rows, 7, 2, 10) and got["corporaxy"][4] == "corpora" and got[f"{long}c"][4] == long
