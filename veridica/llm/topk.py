"""Exact top-k inner products by tiles (operator 10).

Vectors are quantised to integers, floor(1024 x). Queries go out in blocks of at most ``BLOCK`` rows and
``BLOCK_BYTES``, one after the other: a block's lists are written, its broadcast is destroyed, and only then the next
comes to the driver, so memory does not grow with the queries; each pass reads the shards once.
A tile is a block of queries times
an Arrow batch of candidates: one matrix product, a partial selection of the k best of each query, merged into the
list that the task holds. The lists of all tasks merge by a tree: groups of ``FAN`` first, then by query.
Products are exact: doubles where all sums stay below 2**53, Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

BLOCK, BLOCK_BYTES, TILE, FAN = 8192, 32 << 20, 2048, 64
#: no score: true ones beyond a long end at the long's ends, one above it
_NONE = -(2**63) + 1


def quantised(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(vec_id, q array<double> of whole numbers); rows whose vector is null, or holds null or non-finite components, or whose id is null, go."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # doubles from 2**53 on are whole numbers, and floor() gives a long
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.when(fine, whole).alias("q")).where("q is not null and vec_id is not null")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    if not queries.shape[1] or np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * queries.shape[1] < 2**53:
        return (queries @ tile.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in queries], dtype=object) @ np.array([[int(v) for v in r] for r in tile], dtype=object).T
    return np.clip(exact, _NONE + 1, 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest, ties to the smaller id; all of one shape."""
    if scores.shape[1] <= k:
        order = np.lexsort((ids, -scores), axis=1)
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    r, c = np.nonzero(scores >= least[:, None])  # the k best and what ties with the last of them
    s, i = scores[r, c], ids[r, c]
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return s[keep].reshape(-1, k), i[keep].reshape(-1, k)


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value  # dim -> (ids, matrix)
        top = {d: (np.full((len(i), 0), _NONE), np.zeros((len(i), 0), dtype=np.int64)) for d, (i, _) in groups.items()}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = np.array(vectors.value_lengths())
            for d in np.unique(dims):
                if d not in groups:
                    continue
                rows = np.flatnonzero(dims == d)
                matrix, own = _matrix(vectors.take(pa.array(rows)), d), ids[rows]
                for lo in range(0, len(rows), TILE):
                    tile, names = matrix[lo : lo + TILE], own[lo : lo + TILE]
                    for q in range(0, len(groups[d][0]), TILE):
                        asked = groups[d][0][q : q + TILE]
                        scores = _scores(groups[d][1][q : q + TILE], tile)
                        scores[asked[:, None] == names[None, :]] = _NONE
                        s, i = _best(scores, np.broadcast_to(names, scores.shape), k)
                        old_s, old_i = top[d][0][q : q + TILE], top[d][1][q : q + TILE]
                        s, i = _best(np.hstack([old_s, s]), np.hstack([old_i, i]), k)
                        if s.shape[1] > top[d][0].shape[1]:
                            pad = s.shape[1] - top[d][0].shape[1]
                            top[d] = np.pad(top[d][0], ((0, 0), (0, pad)), constant_values=_NONE), np.pad(top[d][1], ((0, 0), (0, pad)))
                        top[d][0][q : q + TILE], top[d][1][q : q + TILE] = s, i
        group = TaskContext.get().partitionId() // FAN
        for d, (s, i) in top.items():
            real = s > _NONE
            asked = np.broadcast_to(groups[d][0][:, None], s.shape)[real]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), group)), *(pa.array(x) for x in (asked, i[real], s[real]))], ["node", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``rows`` and ``queries``: (vec_id, q) as ``quantised`` gives them. Returns (query_id, rank, vec_id, score).

    A vector meets those of its own length only. Rows that carry a query's vec_id are its own and are not its
    candidates; of repeated ids among the candidates each row may be listed. A query id that is repeated asks with
    the first of its vectors. No queries, or no candidates, give no rows.
    """
    spark = rows.sparkSession
    asked = saved(queries.groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    n, dim = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(dim or 1, 1))))
    order = [F.col("query_id"), F.col("score").desc(), F.col("vec_id")]
    inner = W.partitionBy("node", "query_id").orderBy(*order[1:])
    near, blocks = None, max(1, -(-n // block))
    for b in range(blocks):
        # blocks by hash, each within a few deviations of its size
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        dims = np.array(some["q"].combine_chunks().value_lengths()) if len(some) else np.zeros(0)
        groups = {int(d): (some["vec_id"].to_numpy()[dims == d], _matrix(some["q"].combine_chunks().take(pa.array(np.flatnonzero(dims == d))), int(d))) for d in np.unique(dims)}
        shared = spark.sparkContext.broadcast(groups)
        found = rows.select("vec_id", "q").mapInArrow(_search(shared, k), "node long, query_id long, vec_id long, score long")
        best = found.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k).drop("r", "node")
        if blocks > 1:
            best = saved(best, "top")
            shared.destroy()
        near = best if near is None else near.union(best)
    outer = W.partitionBy("query_id").orderBy(*order[1:])
    return near.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
