import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symlattice.llm.bpe import Bpe, Encoder, Vocabulary, _texts
from symlattice.llm.queries import op4_bpe, vocabulary_path
from symlattice.session import table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return Encoder(Vocabulary(f.read()))


ODD = ["", " ", "a", "It's we'll 'S x'd", "ΑΣ ΣΑΣ. ΌΔΟΣ", "İstanbul", "éa ́x", "<|startoftext|>hi<|endoftext|> <|x|> <|endoftext|", "a\x1cb\x1dc d e\x85f", "1234 ½ ٣٤", "!!!###$$$", "日本語テキスト", "😀😀 👩‍👩", "x" * 3000, "ab" * 501 + "!", "\u0000\u0001", "ﬁ Å ñ ẞ", "a≯<|endoftext|≯b", "﻿bom", "don''t 's's'ss"]


def test_ids_and_text_are_the_librarys(library, encoder):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeéßΣ 'st\n.,1<|>ñ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    ids, counts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        got, at = ids[at : at + n].tolist(), at + n
        assert got == library.encode(text, add_special_tokens=False).ids, text
    decoded = _texts(encoder.vocab, ids.astype("int64"), counts).to_pylist()
    assert decoded == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


def test_forgetting_changes_nothing(library, encoder, monkeypatch):
    import symlattice.llm.bpe as module

    monkeypatch.setattr(module, "REMEMBERED", 64)
    small = Encoder(encoder.vocab)
    text = " ".join(f"w{i % 97}x" for i in range(1000))
    assert small.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_columns(spark, library):
    codec = Bpe(spark, vocabulary_path())
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "ids null"), (1, "Hello there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_sha256", F.lit("clash"))
    out = df.withColumn("ids", codec.encode(F.col("text"))).withColumn("back", codec.decode(F.col("ids"))).collect()
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == library.decode(ids, skip_special_tokens=False) and r["ids_sha256"] == "clash"
    assert df.limit(0).withColumn("ids", codec.encode(F.col("text"))).count() == 0


def test_one_worker_for_both_ways(spark, library):
    """Ids and decoded text come from one Python node; what travels to the tasks is arrays of some megabytes, not the parsed file."""
    import pickle

    import corpus_pipeline

    codec = Bpe(spark, vocabulary_path())
    rows = [(i, t) for i, t in enumerate([*ODD, None, "word " * 300_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in df.select("text", codec.both(F.col("text")).alias("both")).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["both"]["ids"] == ids and r["both"]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert df.limit(0).select(codec.both(F.col("text"))).count() == 0
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for out in (op4_bpe(spark, "/root/testdata/sf0.001"), corpus_pipeline.encoded(spark, docs, "/root/testdata/sf0.001")):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert len(pickle.dumps(codec.shared.value)) < 5e6


def test_whole_table(spark, library):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = op4_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    assert isinstance(pa.array([1]), pa.Array)
