"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its length in bytes and two polynomial hashes of them.
Hashes of chunks combine by length-shifted arithmetic,
``H(ab) = H(a) * base ** len(b) + H(b)``, so a huge document is cut into
chunks that separate tasks hash. Texts with equal fingerprints are then
compared chunk by chunk with the one that stays; what differs after all (a
collision) goes through another round.

A null text counts as empty. Of equal texts, the row with the largest id stays
(a null id counts as smallest); rows repeated with the same id and text share
one verdict and all count in group_size. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlattice.session import checkpoint

#: Two primes under 2**31 and bases; fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
#: Texts of more bytes are hashed by many tasks.
HUGE = 1 << 23
#: Copies of a text that one task compares with it.
PER_SALT = 2000


def _powers(n: int) -> list[np.ndarray]:
    """base ** (n-1), ..., base ** 0 for each prime."""
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        x = np.ones(n, dtype=np.int64)
        done = 1
        while done < n:  # doubling keeps it vectorised
            step = min(done, n - done)
            x[done : done + step] = x[:step] * pow(b, done, p) % p
            done += step
        out.append(x[::-1].copy())
    return out


_POWERS: list[np.ndarray] = []


def fingerprint(data: np.ndarray) -> tuple[int, int]:
    """Both hashes of the bytes, a chunk at a time."""
    if not _POWERS:
        _POWERS.extend(_powers(CHUNK))
    h = [0, 0]
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK].astype(np.int64)
        n = len(part)
        for i, p in enumerate(PRIMES):
            # sums of 2**16 products under 2**40 stay below 2**56
            h[i] = (h[i] * pow(BASES[i], n, p) + int(part @ _POWERS[i][CHUNK - n :])) % p
    return h[0], h[1]


@F.arrow_udf(T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())]))
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        found = [fingerprint(data[ends[i] : ends[i + 1]]) for i in range(len(texts))]
        yield pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["h0", "h1"])


def _combined(i: int):
    """Fold of the sorted chunks' hashes; every product stays below 2**62."""
    p = PRIMES[i]
    return F.aggregate("chunks", F.lit(0).cast("long"), lambda h, c: (h * c[f"shift{i}"] + c[f"h{i}"]) % p)


@F.udf(T.ArrayType(T.LongType()))
def _shifts(n):
    return [pow(b, n, p) for p, b in zip(PRIMES, BASES, strict=True)]


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """(id, sha, n_bytes, h0, h1), a row for each of docs' (id, text); text is never null."""
    n = F.octet_length("text")
    whole = docs.filter(n <= huge).select("id", F.sha2("text", 256).alias("sha"), n.alias("n_bytes"), _fingerprints("text").alias("f")).select("id", "sha", "n_bytes", "f.h0", "f.h1")
    raw = F.col("raw")
    pieces = (
        docs.filter(n > huge).select("id", F.sha2("text", 256).alias("sha"), n.alias("n_bytes"), F.encode("text", "UTF-8").alias("raw"))
        .select("id", "sha", "n_bytes", F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"cast((n_bytes - 1) div {huge} as int)")), lambda i: F.struct(i.alias("at"), F.substring(raw, i * huge + 1, F.lit(huge)).alias("part")))).alias("c"))
        .select("id", "sha", "n_bytes", "c.at", "c.part").repartition("sha", "at")
        .select("id", "sha", "n_bytes", "at", _fingerprints("part").alias("f"), _shifts(F.octet_length("part")).alias("s"))
    )
    chunk = F.struct("at", F.col("f.h0").alias("h0"), F.col("f.h1").alias("h1"), F.col("s")[0].alias("shift0"), F.col("s")[1].alias("shift1"))
    joined = (
        pieces.groupBy("id", "sha", "n_bytes").agg(F.array_sort(F.collect_set(chunk)).alias("chunks"), F.count(F.when(F.col("at") == 0, 1)).alias("times"))
        .select("id", "sha", "n_bytes", _combined(0).alias("h0"), _combined(1).alias("h1"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .drop("col")
    )
    return whole.unionByName(joined)


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, hash_mask: int | None = None) -> DataFrame:
    """(id, sha, keep_id, group_size, kept), a row for each row of documents.

    hash_mask keeps only so many values of the hashes, to make collisions in tests.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = fingerprints(docs, huge)
    if hash_mask is not None:
        rows = rows.withColumns({"n_bytes": F.lit(0), "h0": F.col("h0") % hash_mask, "h1": F.lit(0)})
    rows = checkpoint(rows.withColumn("round", F.lit(0)))
    key = ["n_bytes", "h0", "h1", "round"]
    while True:
        groups = checkpoint(rows.groupBy(*key).agg(F.max("id").alias("keep_id"), F.max(F.struct("id", "sha"))["sha"].alias("keep_sha"), F.count("*").alias("group_size")))
        odd = _unequal(docs, rows, groups, key)
        if odd.isEmpty():
            break
        rows = checkpoint(rows.join(odd.withColumn("odd", F.lit(1)), "sha", "left").withColumn("round", F.col("round") + F.coalesce("odd", F.lit(0))).drop("odd"))
    return rows.join(groups.drop("keep_sha"), key).select("id", "sha", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def _unequal(docs: DataFrame, rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Digests of the texts that differ from the text their group keeps, found by comparing the texts themselves."""
    shared = groups.filter("group_size > 1")
    # one task compares at most about PER_SALT copies of a text: the text that stays goes to each of those tasks
    salts = F.expr(f"cast((group_size - 1) div {PER_SALT} + 1 as int)")
    members = rows.join(shared, key).select("id", "sha", F.col("n_bytes").alias("bytes"), F.struct(*key).alias("key"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))).alias("stays"), salts.alias("salts")).distinct()
    named = docs.select(F.col("id").alias("of_id"), F.sha2("text", 256).alias("of_sha"), "text")
    texts = named.join(members, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha")))
    size, raw = F.lit(CHUNK * 16), F.encode("text", "UTF-8")
    chunked = texts.select("sha", "key", "stays", "salts", "id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"cast(greatest(octet_length(text) - 1, 0) div {CHUNK * 16} as int)")), lambda i: F.substring(raw, i * size + 1, size))).alias("at", "part"))
    ours = chunked.filter(~F.col("stays")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    theirs = chunked.filter("stays").dropDuplicates(["key", "at"]).select("key", "at", F.col("part").alias("kept_part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    differs = F.coalesce(F.col("part") != F.col("kept_part"), F.lit(True))
    return checkpoint(ours.join(theirs, ["key", "salt", "at"], "left").filter(differs).select("sha").distinct())
