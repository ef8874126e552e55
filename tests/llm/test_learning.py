import math
import re
from zlib import crc32

import numpy as np
import pytest

from symlattice.llm import langid, toxicity
from symlattice.llm.queries import op5_toxicity, op6_langid, vocabulary_path
from symlattice.session import table

SF = "/root/testdata/sf0.01"


def out(i):
    return crc32(str(i).encode()) % 3 == 1


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    got = {r["doc_id"]: r for r in op5_toxicity(spark, SF).collect()}
    assert len(got) == table(spark, SF, "documents").count()
    for i, r in got.items():
        assert r["held_out"] == out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(labels[i], got[i]["predicted"]) for i in labels if out(i) and i in got]
    assert np.mean([t == p for t, p in held]) > 0.9


def small(spark):
    rows = [(i, f"fine words here number {i}. lovely day" + (". you idiot troll! bye" if i % 3 == 0 else "")) for i in range(90)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (5, None), (7, 9)], "doc_id long, toxic int")


def test_toxicity_locates_sentences(spark):
    docs, labels = small(spark)
    model = toxicity.learnt(spark, docs, labels)
    text = "All is well here. What an IDIOT troll you are! Fine day\nlovely words"
    odd = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "idiot", "x"), (1, text, "x"), (4, "fine. " * 20_000 + "idiot troll", "x"), (5, "1234 %% 😀", "x")], "doc_id long, text string, score string")
    got = toxicity.score(odd, model).collect()
    assert [r["predicted"] for r in got[:3] + got[4:]] == [1, 0, 0, 1, 1, 0]
    s = got[0]["offending"]
    assert len(s) == 1 and "IDIOT" in text[s[0]["start"] : s[0]["end"]] and "well" not in text[s[0]["start"] : s[0]["end"]]
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert [r["__toxic"] for r in toxicity.flag(odd, model).collect()] == [r["predicted"] for r in got]


def test_noisy_or():
    m = toxicity.Model({"a": 0, "b": 1}, np.array([1.5, -2.0]), -1.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    want = 1 - (1 - p(0.5)) * (1 - p(-1.5))  # the sentence without known words has none
    assert abs(m.score("a a. A b! c d") - want) < 1e-12


def test_no_labels(spark):
    docs, labels = small(spark)
    model = toxicity.learnt(spark, docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}


def test_language_held_out(spark):
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in op6_langid(spark, SF).collect()}
    assert got.keys() == langs.keys() and all(r["held_out"] == out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    for i, (_, text) in langs.items():
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    held = [langs[i][0] == got[i]["lang_pred"] for i in langs if out(i) and langs[i][0]]
    assert np.mean(held) > 0.97


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in (("the house of the old man", "en"), ("das haus und der mann", "de"), (None, "fr"), ("sin lengua", None))]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary_path("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations(model):
    pieces, _ = langid._pieces(vocabulary_path("piece_bpe_32k.model"))
    index = {int(k): i for i, k in enumerate(model.keys)}
    by_text = {}
    for p in pieces:
        if 0 < len(p) <= langid.LONGEST and p == p.lower() and not p.startswith("<"):
            by_text[p] = model.probs[index[int(langid._prefixes(langid._codes([p]))[0, -1])]]

    def total(word, lang):
        a = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            a[j] = a[j - 1] * model.unknown + sum(a[i] * by_text[word[i:j]][lang] for i in range(max(0, j - langid.LONGEST), j) if word[i:j] in by_text)
        return math.log(a[-1])

    words = ["house", "haus", "x", "éñ", "thehouseoftheoldman", "日本"]
    got = model.word_logs(words)
    for w, row in zip(words, got, strict=True):
        for k in range(len(model.langs)):
            assert abs(row[k] - total("▁" + w, k)) < 1e-6
    assert np.isfinite(model.word_logs(["q" * 5000])).all()


def test_language_rows(spark, model):
    rows = [(1, "the old house"), (2, None), (3, ""), (4, "1234 !! ½ ²"), (5, "DER MANN"), (None, "das haus"), (1, "the old house"), (6, "the man " * 50_000)]
    got = [(r["id"], r["lang_pred"]) for r in langid.identify(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, score string"), model).collect()]
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "de"), (1, "en"), (6, "en")]
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), vocabulary_path("piece_bpe_32k.model"))
    assert nothing.text("hello") == ("und", 0.0)


def test_language_whole_query(spark):
    """Every row against sums over dictionaries, counted anew; sf0.001 has fewer documents than the fit's bound."""
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").collect()
    pieces, sp = langid._pieces(vocabulary_path("piece_bpe_32k.model"))
    use = {p for p in pieces if p == p.lower() and not p.startswith("<")}
    langs = sorted({r["lang"] for r in rows if r["lang"] and not out(r["doc_id"])})
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = {g: dict.fromkeys(use, 0.5) for g in langs}
    for r in rows:
        if r["lang"] and not out(r["doc_id"]):
            for w in words(r["text"]):
                for p in map(sp.id_to_piece, sp.encode(w)):
                    if p in use:
                        counts[r["lang"]][p] += 1
    probs = {g: {p: n / sum(c.values()) for p, n in c.items()} for g, c in ((g, counts[g]) for g in langs)}
    logs = {}

    def log(w, g):
        if (w, g) not in logs:
            w_, a = "▁" + w, [1.0]
            for j in range(1, len(w_) + 1):
                a.append(a[-1] * 1e-9 + sum(a[i] * probs[g].get(w_[i:j], 0) for i in range(max(0, j - langid.LONGEST), j)))
            logs[w, g] = math.log(a[-1])
        return logs[w, g]

    got = {r["doc_id"]: r for r in op6_langid(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        found = [w for w in words(r["text"]) if any(map(str.isalpha, w))]
        total = [sum(log(w, g) for w in found) for g in langs]
        share = [math.exp(t - max(total)) for t in total]
        g = got[r["doc_id"]]
        assert g["lang_pred"] == (langs[int(np.argmax(total))] if found else "und")
        assert abs(g["score"] - (max(share) / sum(share) if found else 0)) < 1e-6


def test_language_parts():
    """Long texts are cut between words, also where the table of words overflows."""
    t = "ab cd " * 10 + "x" * 50 + " y"
    langid_together, langid.TOGETHER = langid.TOGETHER, 16
    try:
        assert "".join(t[a:b] for a, b in langid._parts(t)) == t
        assert [w for a, b in langid._parts(t) for w in langid._WORDS.findall(t, a, b)] == t.split()
    finally:
        langid.TOGETHER = langid_together
