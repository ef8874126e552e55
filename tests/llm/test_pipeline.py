import re
from collections import Counter

import corpus_pipeline
from symlattice.llm import toxicity
from symlattice.session import table
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns
    start, clean, distinct, apart, mixed, ids = seen
    model = toxicity.learnt(spark, spark.createDataFrame(start), table(spark, SF, "labels"))
    assert sorted(clean) == sorted(r for r in start if model.score(r["text"] or "") < 0.7)
    best = {}
    for r in clean:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(distinct) == sorted(r for r in clean if best[r["text"]] == r["doc_id"])
    kept = {i for i, _, _, ok in brute([(r["doc_id"], r["text"]) for r in distinct]) if ok}
    assert sorted(apart) == sorted(r for r in distinct if r["doc_id"] in kept)
    times = Counter(mixed)
    assert set(times) <= set(apart) and max(times.values()) <= 2
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
    total = sum(map(size, apart))
    assert abs(sum(map(size, mixed)) - 1.5 * total) < 0.3 * total
    assert Counter(r["doc_id"] for r in ids) == Counter(r["doc_id"] for r in mixed)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.distinct_texts(spark, docs, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "a b c d e f", "en", "s", 11)], key=repr)
    assert corpus_pipeline.no_near_copies(spark, docs, SF).count() == 6
    assert corpus_pipeline.encoded(spark, corpus_pipeline.mixed(spark, docs, SF), SF).count() >= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_same_row_stays_under_any_partitioning(spark):
    """Rows of one id and text that differ in other columns, nulls among them: the least as JSON stays."""
    rows = [(1, "one", "b", "en"), (1, "one", "a", None), (1, "one", "a", "de"), (1, "one", None, "en"), (2, None, "c", None), (2, "", "b", None), (None, "two", "z", "en"), (None, "two", "y", "en")]
    kept = set()
    for n, order in ((1, rows), (4, rows[::-1]), (7, rows[3:] + rows[:3])):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, lang string").repartition(n)
        kept.add(tuple(sorted(map(tuple, corpus_pipeline.distinct_texts(spark, docs, SF).collect()), key=repr)))
    assert len(kept) == 1
    (rest,) = kept
    assert set(rest) == {(1, "one", None, "en"), (2, "", "b", None), (None, "two", "y", "en")} and len(rest) == 3
