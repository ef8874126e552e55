"""Groups of spelling variants: words one edit apart, found by Gram matrices of their letter counts.

One inserted or deleted code point changes one count by one, a replaced one
two of them, so two such words' count vectors are at a squared distance of one
or two, and their lengths differ by one at most. Words lie in blocks by length
and by how many letters of each of a few classes they have; an edit moves a
word to one of a few neighbouring blocks, and only those meet. There, one
matrix product gives all squared distances, pairs at most two apart stay, and
the edit itself is verified. Blocks that hold many words, or long ones, are
split by a hash of the word, so that no task holds more than a matrix of
bounded size, and equal words never meet as they are counted before.

Runs of A-Z, a-z and U+00C0 to U+00FF are words, A-Z lower-cased. Null texts
and empty tables have none; a null id counts as an empty text; repeated rows
count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.operators.fixpoint import chains
from symlattice.session import checkpoint, free

#: Classes of letters that tell blocks apart; words and code points that a split of a block holds, more or less.
CLASSES, SPLIT_WORDS, SPLIT_POINTS = 5, 512, 1 << 19
#: Words whose counts a task holds before it passes them on.
HELD = 200_000

_LETTERS = {*range(97, 123), *range(0xC0, 0x100)}
_COLUMNS = sorted(_LETTERS)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))
_PAIR = "word_a string, n_a long, word_b string, n_b long"


def damaged(doc: str, run: bytes, every: int) -> bytes:
    """The run as this document spells it: every so many runs, by a checksum of both, lack a letter."""
    h = zlib.crc32(f"{doc}:{run.decode('latin-1')}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % every == 0 else run


def counts(docs: DataFrame, least_length: int, least_count: int, every: int = 31) -> DataFrame:
    """(word, n) of all texts of docs (doc_id, text), as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # one byte a letter; whatever lies beyond U+00FF becomes a question mark, which no word holds
                found = Counter((text.as_py() or "").encode("latin-1", "replace").translate(_FOLD).split())
                for w, n in found.items():
                    if len(w) >= least_length and len(w := damaged(doc, w, every)) >= least_length:
                        held[w] += n
                if len(held) > HELD:
                    yield flushed()
        if held:
            yield flushed()

    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text").mapInArrow(run, "word string, n long")
    return checkpoint(each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def _blocks(words: DataFrame) -> DataFrame:
    """(length, classes, part, words, n): the words of a part one after another, all of one length, and their counts."""
    points = F.transform(F.split("word", ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    of = lambda k: F.size(F.filter(points, lambda p: p == k))
    classes = [of(k) for k in range(CLASSES)]
    keyed = words.select("word", "n", F.length("word").alias("length"), F.array(*classes).alias("classes"))
    sized = keyed.groupBy("length", "classes").agg(F.count("*").alias("m"))
    parts = F.greatest(F.ceil(F.col("m") / SPLIT_WORDS), F.ceil(F.col("m") * F.col("length") / SPLIT_POINTS)).cast("int")
    parted = keyed.join(sized.select("length", "classes", parts.alias("parts")), ["length", "classes"])
    parted = parted.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    held = parted.groupBy("length", "classes", "part").agg(F.collect_list(F.struct("word", "n")).alias("words"))  # a part's words, SPLIT_WORDS or so
    return held.select("length", "classes", "part", F.concat_ws("", "words.word").alias("words"), F.col("words.n").alias("n"))


def _neighbours():
    """The blocks that an edit can move a word to and that come after its own: same length, or one longer. As (length, classes) of the moved counts."""
    moves = [F.struct(F.col("length").alias("length"), F.col("classes").alias("classes"))]
    at = lambda i: F.lit(i)
    shift = lambda c, up, down: F.transform(c, lambda x, i: x + F.when(i == at(up), 1).otherwise(0) - F.when(i == at(down), 1).otherwise(0))
    for up in range(CLASSES):
        moves.append(F.struct((F.col("length") + 1).alias("length"), shift(F.col("classes"), up, -1).alias("classes")))
        # a replacement moves between two classes: taken once, from the side whose letter gains in the lower class
        moves += [F.struct(F.col("length").alias("length"), shift(F.col("classes"), up, down).alias("classes")) for down in range(up + 1, CLASSES)]
    return F.array(*moves)


def _matrix(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words, a row of codes each."""
    m, length = codes.shape
    cells = np.repeat(np.arange(m) * 256, length) + codes.ravel()
    wide = np.float64 if length > 2000 else np.float32  # sums of squares stay exact
    return np.bincount(cells, minlength=m * 256).reshape(m, 256)[:, _COLUMNS].astype(wide)


def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of words of two blocks (a row of codes each) that one edit tells apart; y's words as long as x's or longer by one."""
    u, v = _matrix(x), _matrix(y)
    squared = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T)
    i, j = np.nonzero(squared <= 2)
    keep, step = [], max(1, (1 << 24) // y.shape[1])
    for s in range(0, len(i), step):
        p, q = x[i[s : s + step]], y[j[s : s + step]]
        if x.shape[1] == y.shape[1]:
            keep.append((p != q).sum(1) == 1)
        else:  # the common beginning and the common end cover the shorter word
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            keep.append(head + tail >= x.shape[1])
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(words, n) -> tuple[np.ndarray, np.ndarray]:
        n = n.values.to_numpy()
        return np.frombuffer(words.as_py().encode("latin-1"), np.uint8).reshape(len(n), -1), n

    spelt = lambda codes: pa.array([r.tobytes().decode("latin-1") for r in codes], pa.string())
    for batch in batches:
        for same, a, na, b, nb in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 5)), strict=True):
            (a, na), (b, nb) = block(a, na), block(b, nb)
            i, j = near(a, b)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield pa.RecordBatch.from_arrays([spelt(a[i]), pa.array(na[i]), spelt(b[j]), pa.array(nb[j])], names=["word_a", "n_a", "word_b", "n_b"])


def pairs(words: DataFrame) -> DataFrame:
    """(word_a, n_a, word_b, n_b) of every two of the words (word, n), each once, that differ by one edit; as a table."""
    blocks = checkpoint(_blocks(words))
    left = blocks.select(F.col("words").alias("a"), F.col("n").alias("na"), F.col("part").alias("part_a"), F.col("length").alias("own_length"), F.col("classes").alias("own_classes"), F.explode(_neighbours()).alias("to"))
    left = left.select("a", "na", "part_a", "own_length", "own_classes", "to.length", "to.classes")
    met = left.join(blocks.select("length", "classes", F.col("part").alias("part_b"), F.col("words").alias("b"), F.col("n").alias("nb")), ["length", "classes"])
    own = (F.col("own_length") == F.col("length")) & (F.col("own_classes") == F.col("classes"))
    met = met.filter(~own | (F.col("part_a") <= F.col("part_b"))).select((own & (F.col("part_a") == F.col("part_b"))).alias("same"), "a", "na", "b", "nb")
    out = checkpoint(met.mapInArrow(_compared, _PAIR))
    free(blocks)
    return out


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    form: of the words one edit away the most frequent (ties: the least in
    code-point order), if it is so many times as frequent; root: where
    following forms ends, the word itself if it has none.
    """
    words = counts(docs, least_length, least_count)
    found = pairs(words)
    links = found.select(F.col("word_a").alias("word"), F.col("word_b").alias("to"), F.col("n_b").alias("n_to")).unionByName(found.select(F.col("word_b").alias("word"), F.col("word_a").alias("to"), F.col("n_a").alias("n_to")))
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_to")).alias("m"), F.col("to").alias("to"))).alias("best"))
    held = words.join(best, "word", "left")
    strong = -F.col("best.m") >= F.col("n") * times
    formed = checkpoint(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.to")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    # forms are ever more frequent, so chains end: their links are followed by doubling
    ends = chains(formed.filter("form is not null").select(F.col("word").alias("id"), F.col("form").alias("next"))).select(F.col("id").alias("word"), F.col("end").alias("root"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
