"""The corpus pipeline: each stage works on all that the one before kept, and its rows replace them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm import bpe, exact_dedup, minhash, mixing, queries, toxicity
from symlattice.session import shared_dir, table, write

#: No SQL expresses the trained scores, the sketches or BPE.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic, each row by its own text."""
    model = toxicity.learnt(spark, docs, table(spark, sf_dir, "labels"))
    verdict = toxicity.flag(docs, model)
    return verdict.filter("__toxic = 0").drop("__toxic")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id; of several rows with that id, the one whose other columns come first as JSON (without null fields), however the rows are partitioned."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("id").alias("__id"), F.col("sha").alias("__sha")).distinct()
    named = docs.withColumn("__text", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = named.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha")))
    # the text is the group's own, so only the other columns decide; they alone are compared
    rest = F.to_json(F.struct(*(c for c in docs.columns if c != "text")))
    first = found.groupBy("__id", "__sha").agg(F.min_by(F.struct(*docs.columns), rest).alias("__row"))
    return first.select("__row.*")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id."""
    gone = minhash.near_dedup(docs).filter("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix repeats it."""
    rows = mixing.mix(docs, out="__outcome").filter("__outcome.repeats > 0")
    return rows.withColumn("__outcome", F.explode(F.array_repeat(F.lit(1), F.col("__outcome.repeats")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the text that they decode to."""
    codec = bpe.Bpe(spark, queries.vocabulary_path())
    ids = docs.select("doc_id", "source", codec.both(F.col("text")).alias("both"))
    return queries.with_digests(ids.select("doc_id", "source", "both.ids", "both.decoded")).drop("decoded")


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", distinct_texts),
    ("minhash near-dedup", no_near_copies),
    ("mixing sources", mixed),
    ("bpe encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        write(out, f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
