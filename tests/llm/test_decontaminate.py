import random

import pytest
from pyspark.sql import functions as F

from symlattice.llm import decontaminate as d


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= "\x80" else " " for c in text or "")
    return [w for w in fold.split(" ") if w]


def brute(docs, items, window):
    out = []
    for k, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for i in range(max(1, len(q) - window + 1)) if q else ():
                x = q[i : i + window]
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit |= {*range(s, s + len(x))}
                        found.add("" if item is None else str(item))
        out.append((k, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def near(docs, items, span):
    out = set()
    for k, text in docs:
        w = words(text)
        for item, t in items:
            q, spans = {*words(t)}, []
            for s in range(len(w)) if q else ():
                ends = [next((e for e in range(s, min(len(w), s + span)) if w[e] == x), None) for x in q]
                if w[s] in q and None not in ends:
                    spans.append((s, max(ends) + 1))
            if spans:
                out.add((k, str(item), tuple(d._merged(spans))))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", range(3))
def test_phrases_and_proximity(spark, seed, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", 200)
    monkeypatch.setattr(d, "QUERY_BYTES", 120)
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice(["a", "B", "c", "ß", "é1", "a,", "日本"]) for _ in range(rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(30)] + [(None, None), (3, "A b-c"), (3, "A b-c"), (7, ""), (8, "...")]
    items = [(i, text(9)) for i in range(8)] + [(None, "a b c"), (2, "c c a b"), (5, None), (6, "!!")]
    a, b = tables(spark, docs, items)
    index = d.build(a.repartition(3))
    assert index.count() > 3
    got = [(r[0], r[1], r[2], tuple(r[3]), r[4]) for r in d.contamination(index, b, window=4).collect()]
    assert sorted(got, key=repr) == brute(docs, items, 4) and any(r[2] for r in got) and not all(r[4] for r in got)
    some = [(i, t) for i, t in items[:8] if 1 < len({*words(t)}) < 5]
    hits = d.proximity(index, tables(spark, [], some)[1], span=6)
    at = {(r["doc_id"], r["item_id"], tuple(zip(r["starts"], r["ends"], strict=True))) for r in hits.join(d.documents(index), ["shard", "at"]).collect()}
    assert at == near(docs, some, 6) and at


def test_odd_tables(spark):
    """Empty tables, columns that clash, a very long text and a passage that stands in every document."""
    docs, items = tables(spark, [], [])
    assert d.contamination(d.build(docs), items).isEmpty()
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"x{i} {passage} y") for i in range(200)] + [(1000, "lorem " * 300_000 + passage), (1001, passage[4:])]
    docs, items = tables(spark, rows, [(1, passage), (2, "one two three four five six seven eight nine ten")])
    odd = docs.withColumns({"shard": F.lit("x"), "at": F.lit(1), "terms": F.lit(None), "n_hit": F.lit(0)})
    index = d.build(odd)
    got = {r["doc_id"]: r for r in d.contamination(index, items.withColumn("starts", F.lit(1))).collect()}
    assert len(got) == 202 and all(r["n_hit"] == 12 and r["items"] == ["1", "2"] for k, r in got.items() if k != 1001)
    assert got[1000]["n_words"] == 300_012 and got[1001]["items"] == ["1"] and got[1001]["n_hit"] == 11
    assert not d.contamination(index, tables(spark, [], [])[1]).filter("contaminated").count()
