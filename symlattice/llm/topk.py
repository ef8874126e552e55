"""Exact top-k search by distributed histogram selection.

Every query meets every candidate in blocks; what a pair of blocks emits is a
histogram of scores, never the scores. Rounds of histograms narrow each
query's k-th score from a wide bin to one value; a last pass keeps what lies at
or above it and breaks ties by the smaller id.

Rows whose id is null, whose vector is null or which hold a null or non-finite
component take no part. Vectors of unequal length are compared as if the
shorter were padded with zeros; an empty vector scores 0. A query with fewer
than k candidates gets them all. Rows with equal ids are separate candidates;
a query never meets rows of its own id. Products beyond 64 bits saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.session import checkpoint

BLOCK = 4096
QUERY_BLOCK = 512
SLOT_ROWS = 1 << 20
BIN_BITS = 11
NO_FLOOR = -(2**63)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    v = F.col(vec_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("x")
    )


def _pack(size: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                lists = part.column(1)
                flat, counts = np.asarray(lists.flatten(), dtype=np.int64), np.diff(np.asarray(lists.offsets, dtype=np.int64))
                dim = int(counts.max(initial=0))
                mat = np.zeros((len(ids), dim), dtype=np.int64)
                mat[np.arange(dim)[None, :] < counts[:, None]] = flat
                top = int(max(flat.max(initial=0), -int(flat.min(initial=0))))
                wide = top >= 2**31 - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[0])]), pa.array([dim], pa.int32()), pa.array([min(top, 2**63 - 1)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([mat.astype(np.int64 if wide else np.int32).tobytes()], pa.binary())],
                    names=["first_id", "dim", "top", "ids", "mat"],
                )

    return run


_PACKED = "first_id long, dim int, top long, ids binary, mat binary"


def _matrix(raw: bytes, n: int, dim: int, top: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64 if top >= 2**31 - 1 else np.int32).reshape(n, dim)


def _scores(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores and the mask of allowed pairs of one pair of blocks."""
    q_ids, c_ids = np.frombuffer(r["q_ids"], dtype=np.int64), np.frombuffer(r["ids"], dtype=np.int64)
    dim = min(r["q_dim"], r["dim"])
    q, c = _matrix(r["q_mat"], len(q_ids), r["q_dim"], r["q_top"])[:, :dim], _matrix(r["mat"], len(c_ids), r["dim"], r["top"])[:, :dim]
    if r["q_top"] * r["top"] * max(dim, 1) < 2**53:  # then doubles hold every partial sum exactly
        s = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        s = np.clip(q.astype(object) @ c.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64) if dim else np.zeros((len(q_ids), len(c_ids)), np.int64)
    return q_ids, c_ids, s, q_ids[:, None] != c_ids[None, :]


def _histograms(k: int, shift: int, last_shift: int | None):
    """Counts of (query, bin) for the k best scores of each pair of blocks that lie in the query's present bin."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _, _, s, ok = _scores(r)
                if last_shift is not None:
                    ok &= (s >> last_shift) == np.frombuffer(r["bins"], dtype=np.int64)[:, None]
                s = np.where(ok, s, NO_FLOOR)
                if s.shape[1] > k:  # scores under a block's own k-th can't move the k-th of all
                    s = -np.partition(-(s + 1), k - 1, axis=1)[:, :k] - 1
                at, col = np.nonzero(s != NO_FLOOR)
                pairs, n = np.unique(np.stack([at, s[at, col] >> shift]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), r["block"], dtype=np.int64)), pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int64)), pa.array(n.astype(np.int64))], names=["block", "at", "bin", "n"]
                )

    return run


def _winners(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids, s, ok = _scores(r)
                floor = np.frombuffer(r["bins"], dtype=np.int64)[:, None]
                at, col = np.nonzero(ok & (s > floor))
                tie_at, tie_col = np.nonzero(ok & (s == floor))
                order = np.lexsort((c_ids[tie_col], tie_at))
                tie_at, tie_col = tie_at[order], tie_col[order]
                first = np.arange(len(tie_at)) - np.searchsorted(tie_at, tie_at) < k  # of equal scores only the k smallest ids can win
                at, col = np.concatenate([at, tie_at[first]]), np.concatenate([col, tie_col[first]])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(c_ids[col]), pa.array(s[at, col])], names=["query_id", "id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query; is_query is a condition on the column ``id``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    stats = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks = checkpoint(rows.mapInArrow(_pack(BLOCK), _PACKED))
    bound = blocks.agg(F.count("*").alias("blocks"), F.max("top").alias("top"), F.max("dim").alias("dim")).first()
    slots = max(-(-stats["n"] // SLOT_ROWS), min(bound["blocks"], 2 * spark.sparkContext.defaultParallelism), 1)
    candidates = blocks.withColumn("slot", F.pmod(F.xxhash64("first_id"), F.lit(slots)).cast("int"))
    asked = rows.filter(is_query).repartition(max(1, -(-stats["q"] // QUERY_BLOCK))).mapInArrow(_pack(QUERY_BLOCK), _PACKED)
    asked = checkpoint(asked.select(F.monotonically_increasing_id().alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("first_id", "dim", "top", "ids", "mat"))))

    def met(state: DataFrame | None) -> DataFrame:
        """Each block of queries, with the present bins of its queries, beside each block of candidates."""
        q = asked if state is None else asked.join(state, "block")
        q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        return q.join(candidates, "slot").drop("slot", "first_id", "q_first_id")

    top = min((bound["top"] or 0) ** 2 * max(bound["dim"] or 1, 1), 2**63 - 1)
    shift, last, state = max(0, top.bit_length() + 1 - BIN_BITS), None, None
    while True:
        counts = met(state).mapInArrow(_histograms(k, shift, last), "block long, at int, bin long, n long").groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        if state is not None:
            counts = counts.join(needs.drop("bin"), ["block", "at"])
        down = Window.partitionBy("block", "at").orderBy(F.desc("bin"))
        counts = counts.withColumn("need", F.lit(k) if state is None else F.col("need")).withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bin, from the top, that reaches the k-th score, and how many are still wanted in it
        reached = counts.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("block", "at", "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        needs = checkpoint(reached)
        state = _bins(asked, needs)
        if shift == 0:
            break
        last, shift = shift, max(0, shift - BIN_BITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (
        met(state).mapInArrow(_winners(k), "query_id long, id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )


def _bins(asked: DataFrame, needs: DataFrame) -> DataFrame:
    """(block, bins): each query's present bin, by its place in the block; without one where fewer than k candidates exist."""
    per = needs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "bin"))).alias("found"))  # at most QUERY_BLOCK entries

    def fill(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bins = np.full(len(r["q_ids"]) // 8, NO_FLOOR, dtype=np.int64)
                for x in r["found"] or ():
                    bins[x["at"]] = x["bin"]
                out.append(bins.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bins"])

    return checkpoint(asked.select("block", "q_ids").join(per, "block", "left").select("block", "q_ids", "found").mapInArrow(fill, "block long, bins binary"))
