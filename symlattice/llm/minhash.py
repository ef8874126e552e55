"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five words, as 64-bit hashes. A
sketch has 256 registers: a shingle's leading byte chooses the register, which
keeps the smallest of the remaining bits, compressed to their leading-zero
count and ten mantissa bits. Documents with one and the same set form a class
and one sketch stands for it, so copies cost nothing further.

Registers are banded, six to a band. In each bucket of a band, every class is
paired with the bucket's hub, the class that shares most buckets with others
(for a group of near copies, their original); hubs link most of a group at
once. Such pairs pass the collision-corrected estimate of their Jaccard
similarity, with a margin of five standard deviations, and are then confirmed on
the full sets. Classes that share three bands (``met``; one, for small sets) with
other components afterwards are paired by a prefix filter on their sets, since
trying all pairs of a bucket grows with its square; those pairs pass estimate and
confirmation in the same way. A pair at the threshold shares fewer bands with a
chance of about 8e-7.

Null texts and texts without words have an empty set and link with nothing. A
null id links with nothing and stays. Rows that share an id count as one
document with the links of each. Texts under five words have their whole
sequence as the one shingle. Shingles count as equal when their 64-bit hashes
are.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.operators.fixpoint import components
from symlattice.session import checkpoint, free, slim

WORDS = 5
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
BAND = 6
BANDS = REGISTERS // BAND
#: Bands that a pair of sets of FEW shingles or more has to share; at similarity 0.85 it shares 16 of 42 on average, and less than 3 once in a million.
MET, FEW = 3, 48
#: Of the sets that a prefix filter compares, those of one id in ORDER_FROM give the order of the shingles, and at most ORDERED shingles are told apart by it.
ORDER_FROM, ORDERED = 16, 250_000
#: Bytes of text that are hashed together.
PIECE = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BLANKS = frozenset(np.flatnonzero(_SPACE).tolist())
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A public finaliser of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(_FOLD + np.uint64(1))
_POWER = [np.uint64(pow(_ODD, k, 1 << 64)) for k in range(WORDS + 1)]
_LONG: list[np.ndarray] = [np.array([1], dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    while len(_LONG[0]) < n:
        p = _LONG[0]
        _LONG[0] = np.concatenate([p, p * np.uint64(pow(_ODD, len(p), 1 << 64))])
    return _LONG[0]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in the bytes, A-Z folded."""
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    terms = _BYTE[data[inside]] * _powers(int(lens.max()))[place]
    return starts, mix64(np.add.reduceat(terms, first) + lens.astype(np.uint64))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's begin (one bound more at the end). Bytes are hashed PIECE at a time, cut at blanks."""
    hashes, counts = [], []
    for at, data in _pieces(texts):
        starts, found = word_hashes(data)
        hashes.append(found)
        counts.append((at, starts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    where = np.concatenate([at + starts for at, starts in counts]) if counts else np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.searchsorted(where, ends)])


def _pieces(texts: list[bytes]):
    """(offset, bytes) of parts of the texts with a blank between each two."""
    data = b" ".join(texts)
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in _BLANKS:
            end += 1
        yield at, np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - at, offset=at)
        at = end


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = _words(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS if len(rolled) else 0):
        rolled += words[k : k + len(rolled)] * _POWER[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            h = sum(int(w) * int(_POWER[k]) for k, w in enumerate(words[a:b])) + (b - a)
            out.append(mix64(np.array([h & _MASK], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def compress(rest: np.ndarray) -> np.ndarray:
    """Leading zeros of the 56 remaining bits and the mantissa bits after the leading one; 0 stands for an empty register."""
    width = 64 - REGISTER_BITS
    f = np.maximum(rest, np.uint64(1))
    top = np.floor(np.log2(f.astype(np.float64))).astype(np.int64)
    top = np.where((f >> np.minimum(top, 63).astype(np.uint64)) == 0, top - 1, top)  # doubles may round up to the next power
    zeros = width - 1 - top
    shift = np.maximum(top - MANTISSA, 0).astype(np.uint64)
    mantissa = np.where(top >= MANTISSA, f >> shift, f << np.maximum(MANTISSA - top, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros + 1) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)


_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - REGISTER_BITS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: the first hash of each register's range is its smallest."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(hashes):
        at = np.searchsorted(hashes, _BOUNDS)
        full = np.diff(np.append(at, len(hashes))) > 0
        out[full] = compress(hashes[at[full]] & np.uint64((1 << (64 - REGISTER_BITS)) - 1))
    return out


def _texts(batch: pa.RecordBatch, column: int):
    """(rows, their texts as bytes), some PIECE bytes at a time, without a copy of the column."""
    texts = batch.column(column)
    rows, part, size = [], [], 0
    for i in range(batch.num_rows):
        t = texts[i].as_buffer()
        t = t.to_pybytes() if t is not None else b""
        rows.append(i)
        part.append(t)
        size += len(t)
        if size >= PIECE:
            yield rows, part
            rows, part, size = [], [], 0
    if rows:
        yield rows, part


def _sketches(batches):
    for batch in batches:
        for rows, texts in _texts(batch, 1):
            sets = shingle_sets(texts)
            with np.errstate(over="ignore"):
                prints = [(int(np.bitwise_xor.reduce(mix64(s))) if len(s) else 0, int(np.add.reduce(mix64(s + np.uint64(_ODD)))) if len(s) else 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array([p[k] for p in prints], dtype=np.uint64).view(np.int64)) for k in (0, 1)), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                names=["id", "n", "f0", "f1", "regs"],
            )


def _sets(batches):
    for batch in batches:
        for rows, texts in _texts(batch, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([s.view(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))], names=["id", "hashes"])


def _hashes(batches):
    for batch in batches:
        for _, texts in _texts(batch, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts)).view(np.int64))], names=["h"])


def most_frequent(hashes: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Some ``most`` at most of the values of (h), with their counts: all that are as frequent as the histogram of counts allows, sorted as unsigned numbers."""
    counted = checkpoint(hashes.groupBy("h").count().filter("count > 1"))
    # a few hundred rows: sizes of counts in eighths of an octave
    size = F.floor(F.log2("count") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counted.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > most:
            break
        least = r["size"]
    found = counted.filter(size >= least).toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "count": pa.array([], pa.int64())})
    free(counted)
    known, counts = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


def _prefixes(percent: int, often: np.ndarray, counts: np.ndarray):
    """The first shingles of each set, rarest first, that a similar set has one of at least; often is sorted, counts go with it."""

    def run(batches):
        for batch in batches:
            for rows, texts in _texts(batch, 1):
                out = []
                for i, s in zip(rows, shingle_sets(texts), strict=True):
                    if len(s):
                        known = np.zeros(len(s), dtype=np.int64)
                        if len(often):
                            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                            known = np.where(often[at] == s, counts[at], 0)
                        first = s[np.lexsort((mix64(s), known))[: len(s) * (100 - percent) // 100 + 1]]
                        out.append((i, len(s), first))
                lens = [len(f) for *_, f in out]
                ids = batch.column(0).take(pa.array(np.repeat(np.array([i for i, *_ in out], dtype=np.int64), lens)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.repeat(np.array([n for _, n, _ in out], dtype=np.int32), lens)), pa.array(np.concatenate([f for *_, f in out] or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lens] or [np.zeros(0, np.int32)]))],
                    names=["id", "n", "h", "place"],
                )

    return run


def expected_collisions(n: float, m: float) -> float:
    """Registers in which two disjoint sets of n and m shingles agree by chance: two minima have one exponent and mantissa."""
    total = 0.0
    cells = REGISTERS
    for z in range(40):  # a minimum of n / cells uniform values in the octave with z leading zeros, one of 2**MANTISSA steps
        step = 2.0 ** -(z + 1 + MANTISSA)
        lo = 2.0 ** -(z + 1)
        mids = lo + step * (np.arange(1 << MANTISSA) + 0.5)
        chance = [np.exp(-mids * k / cells) * -np.expm1(-step * k / cells) for k in (n, m)]
        total += float((chance[0] * chance[1]).sum())
    return cells * total


class Collisions:
    """expected_collisions on a grid of powers of two of the sizes, read off between its points."""

    def __init__(self, bits: int = 34):
        self.grid = np.array([[expected_collisions(2.0**i, 2.0**j) for j in range(bits)] for i in range(0, bits)])

    def __call__(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        top = len(self.grid) - 2
        x, y = (np.clip(np.log2(np.maximum(k, 1)), 0, top) for k in (n, m))
        i, j = np.minimum(x.astype(int), top - 1), np.minimum(y.astype(int), top - 1)
        u, v = x - i, y - j
        g = self.grid
        return g[i, j] * (1 - u) * (1 - v) + g[i + 1, j] * u * (1 - v) + g[i, j + 1] * (1 - u) * v + g[i + 1, j + 1] * u * v


def estimate(a: np.ndarray, b: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches (rows), corrected for chance, and the registers it rests on."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.maximum(0.0, same - chance) / np.maximum(used - chance, 1), used


@lru_cache(maxsize=1)
def _collisions() -> Collisions:
    return Collisions()


def _plausible(threshold: float):
    chance = _collisions()  # a grid of a few KB, made once on the driver

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
            n, m = (np.asarray(batch.column(c), dtype=np.float64) for c in (4, 5))
            guess, used = estimate(a, b, chance(n, m))
            margin = 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(guess >= threshold - margin))

    return run


class NearDuplicates:
    """Links between the classes of a table of (id, text), from its sketches on."""

    def __init__(self, docs: DataFrame, percent: int = 85, met: int = MET):
        self.docs, self.percent, self.met = docs, percent, met
        self.rows = checkpoint(docs.mapInArrow(_sketches, "id long, n long, f0 long, f1 long, regs binary"))
        self.classes = checkpoint(self.rows.filter("n > 0 and id is not null").groupBy("n", "f0", "f1").agg(F.min("id").alias("rep"), F.any_value("regs").alias("regs")))

    def buckets(self) -> DataFrame:
        """(key, rep, n, count) of every bucket with two classes at least."""
        width = 2 * BAND
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("regs"), b * width + 1, F.lit(width)).alias("part")))
        full = F.filter(bands, lambda x: x["part"] != F.lit(bytes(width)))
        every = self.classes.select("rep", "n", F.explode(F.transform(full, lambda x: F.xxhash64(x["band"], x["part"]))).alias("key"))
        shared = checkpoint(every.groupBy("key").count().filter("count > 1"))
        keys = checkpoint(every.join(slim(shared), "key"))
        free(shared)
        return keys

    def sets(self, ids: DataFrame, run, schema: str) -> DataFrame:
        """run over the texts of the documents with these ids."""
        return self.docs.join(slim(ids), "id", "left_semi").mapInArrow(run, schema)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are likely by their sketches and whose full sets are as similar as asked."""
        by_id = self.classes.select("rep", "n", "regs")
        left, right = (by_id.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
        likely = pairs.join(left, "a").join(right, "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
        likely = checkpoint(likely.mapInArrow(_plausible(self.percent / 100), "a long, b long").distinct())
        ids = checkpoint(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = checkpoint(self.sets(ids, _sets, "id long, hashes array<long>").repartition("id").dropDuplicates(["id", "hashes"]))
        full = likely.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
        found = self.similar(full)
        free(likely, ids, sets)
        return found

    def shared_ids(self) -> DataFrame:
        """Links (a, b) that ids make which stand on rows of several classes."""
        several = self.rows.filter("n > 0").select("id", "n", "f0", "f1").distinct().groupBy("id").count().filter("count > 1").select("id")
        return self.rows.join(several, "id").join(self.classes, ["n", "f0", "f1"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()

    def by_prefix(self, left: DataFrame) -> DataFrame:
        """Links (a, b) between different components among the classes (rep, component), without trying all pairs.

        Similar sets have a shingle in common among the first of each in any one
        order of all shingles, and its place bounds what they can have in common
        from there on. Shingles that many of these sets hold come last, so one that
        all of a large group hold pairs nobody. How many hold them is counted on one
        set of ORDER_FROM, and only for the ORDERED most frequent: the order changes
        what is tried, never the links. Only the first shingles leave a task.
        """
        ids = checkpoint(left.select(F.col("rep").alias("id")).distinct())
        some = ids.filter(F.pmod(F.xxhash64("id"), F.lit(ORDER_FROM)) == 0)
        known, counts = most_frequent(self.sets(some, _hashes, "h long"), ORDERED)
        first = self.sets(ids, _prefixes(self.percent, known, counts), "id long, n int, h long, place int")
        first = checkpoint(first.join(left.select(F.col("rep").alias("id"), "component"), "id"))
        x, y = (first.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place", "component"))) for s in "xy")
        still = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
        fits = (F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & self.near(F.col("n_x"), F.col("n_y")) & (still * (100 + self.percent) >= (F.col("n_x") + F.col("n_y")) * self.percent)
        pairs = checkpoint(x.join(y, "h").filter(fits).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct())
        found = self.confirmed(pairs)
        free(ids, first, pairs)
        return found

    def similar(self, full: DataFrame) -> DataFrame:
        """The pairs (a, b) of (a, b, set_a, set_b) whose sets are as similar as asked."""
        common = F.size(F.array_intersect("set_a", "set_b"))
        full = full.withColumns({"common": common, "total": F.size("set_a") + F.size("set_b") - common})
        return checkpoint(full.filter(F.col("common") * 100 >= F.col("total") * self.percent).select("a", "b").distinct())

    def near(self, n: Column, m: Column) -> Column:
        """Sets of sizes so unequal can't be similar enough."""
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def linked(self) -> DataFrame:
        """(rep, component) of every class that has a link."""
        keys = self.buckets()
        # a hub shares most buckets with others
        met = keys.groupBy("rep").agg(F.sum("count").alias("met"))
        hubs = keys.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", -F.col("rep"), "n")).alias("hub")).select("key", (-F.col("hub.col2")).alias("hub"), F.col("hub.n").alias("n_hub"))
        close = keys.join(hubs, "key").filter((F.col("rep") != F.col("hub")) & self.near(F.col("n"), F.col("n_hub")))
        tried = checkpoint(close.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
        links = checkpoint(self.confirmed(tried).unionByName(self.shared_ids()))
        parts = components(links)
        # whoever shares buckets with other components is compared with them as well
        where = keys.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        where = checkpoint(where.select("key", "rep", "n", "component"))
        mixed = where.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key")
        left = where.join(mixed, "key", "left_semi").groupBy("rep", "n", "component").count().filter((F.col("count") >= self.met) | (F.col("n") < FEW))
        left = checkpoint(left.select("rep", "component").distinct())
        free(keys, tried, where)
        more = self.by_prefix(left)
        return components(links.unionByName(more)).withColumnRenamed("id", "rep")


def near_dedup(documents: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", met: int = MET) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of documents; kept is the smallest id of each component. With met = 1, classes that share any band are compared."""
    found = NearDuplicates(documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), percent, met)
    linked = found.linked()
    classes = found.classes.join(linked, "rep", "left").select("n", "f0", "f1", F.coalesce("component", "rep").alias("component_id"))
    named = found.rows.join(classes, ["n", "f0", "f1"], "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return named.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def misses(similarity: float) -> float:
    """Chance that a pair of large sets shares fewer than MET bands."""
    p = similarity**BAND
    return sum(math.comb(BANDS, k) * p**k * (1 - p) ** (BANDS - k) for k in range(MET))
