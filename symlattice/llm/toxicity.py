"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's score is a logistic function of its
words and their beginnings (four to six letters, for inflected forms), a document's is the noisy-or of its sentences', and the weights are
fitted to document labels through that noisy-or; then sentences that score
high on their own locate the offence.

The fit sees at most ``per_class`` labelled documents of each class, by the
hash of their id. Its vocabulary are the words and beginnings that are more
frequent in toxic documents by LEAST_GAP standard errors of their log odds, and
of those the ones with the most evidence; sentences without any can't offend.
Weights can't be negative and have a normal prior, so evidence from few
documents stays weak. Null texts count as empty; an empty text scores
like a text of no sentences, 0. Without any label of both classes every score
is 0. Other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm.learning import first_by_hash, remainder
from symlattice.session import checkpoint

PER_CLASS = 8_000
VOCABULARY = 3_000
BEGINNINGS = (4, 5, 6)
REMEMBERED = 100_000
MIN_DOCS = 3
LEAST_GAP = 2.0
#: Fixed bias of a sentence with known features, and strength of the prior on the weights.
BIAS, HOLD = -5.0, 0.015
#: Features that end with less weight are dropped.
LEAST_WEIGHT = 1.0
THRESHOLD = 0.7
#: Words and sentence ends.
_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]+")
_ENDS = frozenset(".!?\n")


class Features(dict):
    """What a token stands for: -2 a sentence's end, -1 nothing known, or the number of a set of features in ``sets``."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words, self.sets, self.numbers = words, [], {}

    def __missing__(self, token: str) -> int:
        found = () if token[0] in _ENDS else tuple(i for f in (token, *(token[:k] + "*" for k in BEGINNINGS if len(token) > k)) if (i := self.words.get(f)) is not None)
        if found and found not in self.numbers:
            self.numbers[found] = len(self.sets)
            self.sets.append(np.array(found))
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = code = self.numbers[found] if found else -2 if token[0] in _ENDS else -1
        return code

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature) pairs, each once and in order."""
        tokens = _TOKENS.findall(text.lower())
        found = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        sentence = np.cumsum(found == -2)
        hits = np.flatnonzero(found >= 0)
        if not len(hits):
            return hits, hits
        sets = [self.sets[k] for k in found[hits].tolist()]
        pairs = np.unique(np.repeat(sentence[hits], [len(x) for x in sets]) * len(self.words) + np.concatenate(sets))
        return pairs // len(self.words), pairs % len(self.words)


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.features = Features(self.words)

    def rates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the sentences with known features, and their logits."""
        sentence, feature = self.features.of(text)
        at, first = np.unique(sentence, return_index=True)
        return at, (np.add.reduceat(self.weights[feature], first) if len(at) else np.zeros(0)) + self.bias

    def score(self, text: str) -> float:
        _, logits = self.rates(text)
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))

    def offending(self, text: str, least: float) -> list[dict]:
        """Spans of the sentences whose own score is at least ``least``."""
        at, logits = self.rates(text)
        out, sentence, start, end = [], 0, None, 0
        scores = {int(a): float(1 / (1 + np.exp(-z))) for a, z in zip(at, logits, strict=True) if 1 / (1 + np.exp(-z)) >= least}
        for m in [*_TOKENS.finditer(text.lower()), None]:
            if m is None or m[0][0] in _ENDS:
                if start is not None and sentence in scores:
                    out.append({"start": start, "end": end, "score": scores[sentence]})
                sentence, start = sentence + 1, None
            else:
                start, end = m.start() if start is None else start, m.end()
        return out


def train_rows(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic) of the bounded sample; only its ids, at most 2 * per_class, are broadcast."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id") != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = first_by_hash(known, "doc_id", "toxic", per_class)
    return checkpoint(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"))


def fit(rows: DataFrame, rounds: int = 300) -> Model:
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    begun = [F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in BEGINNINGS]
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = counts["n"], counts["bad"]
    if not bad or bad == n:
        return Model({}, np.zeros(1), -np.inf)
    by_word = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, *begun))).alias("word")).filter("word <> ''").groupBy("word").agg(F.sum("toxic").alias("b"), F.count("*").alias("m")).filter(F.col("m") >= MIN_DOCS)
    share_bad, share_good = (F.col("b") + 0.5) / (bad + 1), (F.col("m") - F.col("b") + 0.5) / (n - bad + 1)
    odds = F.log(share_bad / share_good)
    gap = odds / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("m") - F.col("b") + 0.5))
    best = by_word.filter(gap >= LEAST_GAP).select("word", (F.col("b") * odds).alias("evidence")).orderBy(F.desc("evidence"), "word").limit(VOCABULARY).collect()
    model = Model({r["word"]: i for i, r in enumerate(best)}, np.zeros(max(1, len(best))), BIAS)
    packed = rows.mapInArrow(_pack(model.words), "toxic int, lens array<int>, ids array<int>").toArrow()
    return _descend(model, packed, rounds)


def _pack(words: dict[str, int]):
    def run(batches):
        features = Features(words)
        for b in batches:
            out = []
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sentence, feature = features.of(text)
                out.append((toxic, np.unique(sentence, return_counts=True)[1], feature))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["toxic", "lens", "ids"])

    return run


def _descend(model: Model, packed: pa.Table, rounds: int) -> Model:
    """Full-batch Adam on the noisy-or likelihood. With u = sum of softplus(logit), a document is clean with chance exp(-u)."""
    packed = packed.combine_chunks()
    toxic = np.asarray(packed["toxic"], dtype=np.float64)
    flat = lambda c: np.asarray(pa.concat_arrays(packed[c].chunks).flatten(), dtype=np.int64)
    per_doc = np.array([len(x) for x in packed["lens"]], dtype=np.int64)
    lens, ids = flat("lens"), flat("ids")
    doc = np.repeat(np.arange(len(toxic)), per_doc)
    sentence = np.repeat(np.arange(len(lens)), lens)
    theta = np.append(model.weights, model.bias)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, theta[ids], len(lens)) + theta[-1]
        u = np.bincount(doc, np.logaddexp(0, z), len(toxic))
        du = np.where(toxic > 0, -1 / np.expm1(np.clip(u, 1e-9, 700)), 1.0)
        dz = du[doc] * sigmoid(z)
        grad = np.append(np.bincount(ids, dz[sentence], len(theta) - 1), 0) + HOLD * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        theta[:-1] = np.maximum(theta[:-1], 0)
    used = [w for w, i in model.words.items() if theta[i] >= LEAST_WEIGHT]
    return Model({w: k for k, w in enumerate(used)}, np.append(theta[[model.words[w] for w in used]], 0 if not used else []), float(theta[-1]))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: float = 0.5) -> DataFrame:
    """(id, score, predicted, offending): spans in characters of the sentences that offend, for documents over the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                scores = [model.score(t) for t in texts]
                spans = [model.offending(t, least) if s >= threshold else [] for t, s in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    names=["id", "score", "predicted", "offending"],
                )

    return documents.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def flag(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents with a column __toxic, 1 for those at the threshold or over."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([int(shared.value.score(t.as_py() or "") >= threshold) for t in texts], pa.int32())

    return documents.withColumn("__toxic", run(F.col(text_col)))


def learnt(spark: SparkSession, documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(train_rows(documents, labels, per_class))
