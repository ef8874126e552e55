"""Benchmark decontamination over a positional inverted index of the training documents.

The index is a table in the shared folder, sharded by blocks of documents: a
row holds a block's terms, how often each occurs and where, so that lists are
intersected within a shard and no posting is ever shuffled, however common its
term. A query starts from the rarest of its terms in the shard; the lists of
the others, each shifted by its offset, are intersected with it in order of
rarity until nothing is left. Queries come in blocks of bounded bytes, each
against all shards.

Words: A-Z lower-cased, runs of ASCII letters and digits and of anything beyond
ASCII. Null texts have no words; repeated rows and repeated or null ids are
documents of their own; items of one id are one item, a null id is an empty
text. Empty tables give empty or unmatched results; further columns of the
inputs, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlattice.session import checkpoint

#: Bytes of text in a shard (a longer document is a shard of its own) and in a block of queries.
SHARD_BYTES, QUERY_BYTES = 4 << 20, 2 << 20
#: Words of a window.
WINDOW = 10

_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; no byte of a longer character is a separator."""
    return (text or b"").translate(_FOLD).split()


def _packed(places: np.ndarray) -> bytes:
    """Steps between places, their bytes by plane: high ones are nearly all zero and compress away."""
    return np.diff(places, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)


def _bases(lengths: np.ndarray) -> np.ndarray:
    """Where each document of a shard begins; a free place after each keeps phrases apart."""
    return np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 1)[:-1]])


def build(docs: DataFrame) -> DataFrame:
    """The index of all documents (doc_id, text), as a table: (shard, ids, lengths, terms, counts, places).

    places holds the lists of all terms one after another, in order of terms.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 33)
        arrow = None
        held, texts, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            number: dict[bytes, int] = defaultdict(count().__next__)
            rows = [np.fromiter(map(number.__getitem__, words(t)), np.int32) for t in texts]
            lengths = np.array([len(r) for r in rows], np.int32)
            terms = np.concatenate(rows)
            places = np.arange(len(terms), dtype=np.int64) + np.repeat(np.arange(len(rows)), lengths)
            order = np.argsort(terms, kind="stable")
            row = [[next(serial)], pa.array([held], pa.list_(arrow)), [lengths], pa.array([list(number)], pa.list_(pa.binary())).cast(pa.list_(pa.string())), [np.bincount(terms, minlength=len(number)).astype(np.int32)], [_packed(places[order])]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in row], names=schema.names)

        for batch in batches:
            arrow = batch.column(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                held.append(k)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= SHARD_BYTES:
                    yield flushed()
                    held, texts, size = [], [], 0
        if held:
            yield flushed()

    return checkpoint(docs.select("doc_id", "text").mapInArrow(shards, schema))


class _Queries:
    """Queries of several terms each, in memory of every task: bounded by QUERY_BYTES of text."""

    def __init__(self, queries: dict[tuple[bytes, ...], set[str]]):
        number: dict[bytes, int] = defaultdict(count().__next__)
        self.lists = [np.array([number[w] for w in q], np.int64) for q in queries]
        self.items = [sorted(i) for i in queries.values()]
        self.terms = [t.decode() for t in number]

    def wanted(self, terms: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term, how often the shard has it and where its list begins."""
        at = pc.index_in(pa.array(self.terms, pa.string()), value_set=terms).fill_null(-1).to_numpy()
        starts = np.cumsum(counts) - counts
        return np.append(counts, 0)[at], np.append(starts, 0)[at]


def _within(some: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Those of some that other holds too; both in order, some the shorter."""
    at = np.searchsorted(other, some)
    at[at == len(other)] = 0
    return some[other[at] == some]


def _phrase(terms: np.ndarray, lists: list[np.ndarray], memo: dict) -> np.ndarray:
    """Places where the terms stand one after another. memo: of the shard, as neighbouring windows begin with the same two lists."""
    rare = sorted(range(len(terms)), key=lambda i: (len(lists[i]), i))
    first = rare[0]
    found = lists[first]
    for nth, i in enumerate(rare[1:]):
        step = i - first
        if nth == 0:
            key = (terms[first], terms[i], step)
            if key not in memo:
                memo[key] = _within(found, lists[i] - step)
            found = memo[key]
        else:
            found = _within(found, lists[i] - step)
        if not len(found):
            break
    return found - first


def _near(lists: list[np.ndarray], span: int, bases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of at most span places of one document that begin with a term and hold all: those that the nearest occurrence of each allows."""
    lists = sorted(lists, key=len)
    anchors = lists[0]
    for other in lists[1:]:
        anchors = anchors[np.searchsorted(other, anchors - span + 1) < np.searchsorted(other, anchors + span)]
    starts = np.unique((anchors[:, None] - np.arange(span)[None, :]).ravel())
    starts = starts[starts >= 0]
    doc = np.searchsorted(bases, starts, "right") - 1
    first, last = np.full(len(starts), np.iinfo(np.int64).max), np.full(len(starts), -1)
    for other in lists:
        after = np.append(other, np.iinfo(np.int64).max)[np.searchsorted(other, starts)]
        first, last = np.minimum(first, after), np.maximum(last, after)
    good = (first == starts) & (last < (bases + lengths)[doc]) & (last - starts < span)
    return starts[good], last[good] + 1


def _search(index: DataFrame, items: DataFrame, split, find) -> DataFrame:
    """(shard, at, item_id, starts, ends): for each document and item, the stretches that find gives, merged where they meet.

    split: the queries that an item's words give; find: (terms, lists, bases, lengths, memo) to (starts, ends).
    """
    spark = index.sparkSession
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    blocks = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES)
    schema = "shard long, at int, item_id string, starts array<int>, ends array<int>"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        queries: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect():  # QUERY_BYTES or so
            for q in split(words(text.encode())):
                queries[q].add(item)
        if queries:
            out = out.unionByName(index.select("shard", "lengths", "terms", "counts", "places").mapInArrow(_matches(spark.sparkContext.broadcast(_Queries(queries)), find), schema))
    return out


def _matches(held, find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Queries = held.value
        for batch in batches:
            for r in range(batch.num_rows):
                shard, lengths, terms, counts, places = (batch.column(i)[r] for i in range(5))
                lengths, counts = (np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in (lengths, counts))
                n, starts = q.wanted(terms.values, counts)
                alive = [i for i, t in enumerate(q.lists) if n[t].all()]
                if not alive:
                    continue
                every, bases, memo, lists, found = _unpacked(places.as_py()), _bases(lengths), {}, {}, defaultdict(list)
                # each list restarts its steps from the last place of the one before: sums over all give the places back
                for i in alive:
                    for t in q.lists[i]:
                        lists.setdefault(t, every[starts[t] : starts[t] + n[t]])
                    begin, end = find(q.lists[i], [lists[t] for t in q.lists[i]], bases, lengths, memo)
                    for d, s, e in zip((np.searchsorted(bases, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
                        for item in q.items[i]:
                            found[d, item].append((s - int(bases[d]), e - int(bases[d])))
                if found:
                    merged = [_merged(x) for x in found.values()]
                    yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(found), pa.int64()), pa.array([d for d, _ in found], pa.int32()), pa.array([i for _, i in found]), *(pa.array([[x[k] for x in m] for m in merged], pa.list_(pa.int32())) for k in (0, 1))], names=["shard", "at", "item_id", "starts", "ends"])

    return run


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def documents(index: DataFrame) -> DataFrame:
    """(shard, at, doc_id, n_words) of every document of the index."""
    return index.select("shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "doc")).select("shard", "at", F.col("doc.ids").alias("doc_id"), F.col("doc.lengths").cast("long").alias("n_words"))


def phrases(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shard, at, item_id, starts, ends): where any window of so many consecutive words of an item (item_id, text) occurs; an item of fewer words is one window."""

    def split(w):
        return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()

    def find(terms, lists, bases, lengths, memo):
        begin = _phrase(terms, lists, memo)
        return begin, begin + len(terms)

    return _search(index, items, split, find)


def proximity(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(shard, at, item_id, starts, ends): where all words of an item stand, in any order, within so many consecutive words of a document."""
    return _search(index, items, lambda w: [tuple(dict.fromkeys(w))] if w else (), lambda terms, lists, bases, lengths, memo: _near(lists, span, bases, lengths))


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every document: its words inside any occurrence of a window, and the ids (texts, in order) of the items with such windows."""
    found = phrases(index, items, window).groupBy("shard", "at").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"))
    step = lambda acc, x: F.struct(F.greatest(acc["reach"], x["ends"]).alias("reach"), (acc["n"] + F.greatest(x["ends"] - F.greatest(acc["reach"], x["starts"]), F.lit(0))).alias("n"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))
    every = documents(index).join(found.select("shard", "at", "items", covered.alias("n_hit")), ["shard", "at"], "left")
    none = F.array().cast("array<string>")
    return every.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
