"""Nearest neighbours by inner product: a block matrix join with exact results.

Vectors are dealt into blocks by a hash of their id. Query blocks meet candidate blocks in an equality
join on the candidate block; each pair of blocks is one tile. Inside a tile, int8 codes are multiplied
(as exact whole numbers in float32) and scaled, and the Cauchy-Schwarz bound of the quantisation error
says how far a product can be off. A pair survives if its upper bound reaches the k-th best so far; only
survivors are recomputed from the original vectors in double precision, and go through a heap of k per
query. The best k of each candidate block are ranked once more across blocks.

Bounds: a tile holds ``QUERY_ROWS`` x ``TILE_ROWS`` products; a candidate block at most about
``MOST_ROWS`` vectors. Nothing is sampled or cut: every query meets every candidate.

Cases: vectors that are NULL, zero, or hold NULL or non-finite components take no part; vectors meet
only vectors of the same length; rows that repeat an id and its vector count once; an id is no neighbour
of itself; ties go to the smaller id; with fewer than k candidates all are returned; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, TILE_ROWS, MOST_ROWS = 1024, 2048, 32768


def takes_part(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale per row, norm of scaled codes, norm of what the codes leave out."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(v - back, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, components added in order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple]]:
    """For each query the k best (score, -id) of one candidate block."""
    heaps: list[list[tuple]] = [[] for _ in q_ids]
    q_codes, q_scale, q_norm, q_left = quantised(q)
    kind = np.float32 if q.shape[1] <= 1000 else np.float64  # products of codes stay exact
    q_codes = q_codes.astype(kind)
    for at in range(0, len(c_ids), TILE_ROWS):
        ids, tile = c_ids[at:at + TILE_ROWS], c[at:at + TILE_ROWS]
        codes, scale, norm, left = quantised(tile)
        near = (q_codes @ codes.T.astype(kind)).astype(np.float64) * q_scale[:, None] * scale
        full = norm + left  # at least the length of the original vector
        off = (q_norm[:, None] * left + q_left[:, None] * full) * (1 + 1e-9) + 1e-300
        own = q_ids[:, None] == ids
        near[own] = -np.inf
        low = near - off
        if low.shape[1] > k:
            reach = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            reach = np.full(len(q_ids), -np.inf)
        full_heaps = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        reach = np.maximum(reach, full_heaps)
        with np.errstate(invalid="ignore"):
            floor = np.where(np.isfinite(reach), reach - 1e-12 * np.abs(reach), -np.inf)
        who, which = np.nonzero((near + off >= floor[:, None]) & ~own)
        for w, score, other in zip(who.tolist(), exact_products(q[who], tile[which]).tolist(), ids[which].tolist()):
            heap, entry = heaps[w], (score, -other)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return heaps


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix (double) of one block, a list of (id, vector)."""
    rows = column.flatten()
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1)


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q = _vectors(batch.column("q").slice(i, 1))
                c_ids, c = _vectors(batch.column("c").slice(i, 1))
                heaps = best_of_block(q_ids, q, c_ids, c, k)
                flat = [(int(q_ids[w]), -neg, score) for w, h in enumerate(heaps) for score, neg in h]
                if flat:
                    query, other, score = zip(*flat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.float64())],
                        names=["query_id", "vec_id", "score"])
    return run


def _blocks(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """One row per block: dim, <name>_block, and the block's vectors, a bounded list."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    return (rows.join(sizes, "dim").groupBy("dim", block.alias(f"{name}_block"))
            .agg(F.collect_list(F.struct("id", "v")).alias(name)))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k candidates with the largest inner product."""
    def sound(df: DataFrame) -> DataFrame:
        return (df.where(takes_part(F.col(vector)) & F.col(id_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"),
                        F.size(vector).alias("dim"))
                .dropDuplicates(["id", "v"]))

    all_c, all_q = sound(candidates), sound(queries)
    width = max(1, candidates.sparkSession.sparkContext.defaultParallelism)
    n = F.count("*")
    per_block = F.greatest(F.lit(2 * k), F.least(F.lit(MOST_ROWS), F.ceil(n / width)))
    c_sizes = all_c.groupBy("dim").agg(F.ceil(n / per_block).cast("long").alias("blocks"))
    q_sizes = all_q.groupBy("dim").agg(F.ceil(n / QUERY_ROWS).cast("long").alias("blocks"))
    q = _blocks(all_q, q_sizes, "q").join(c_sizes, "dim")
    q = q.select("dim", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("c_block"))
    tiles = q.join(_blocks(all_c, c_sizes, "c"), ["dim", "c_block"]).select("q", "c")
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
