"""Exact top-k inner products in whole numbers, as tiled matrix products with a tree of merges.

Queries and candidates are dealt out by a hash of their ids to query tiles and candidate shards of bounded size. Each pair
of a query tile and a shard is one group: the query tile stays in memory, the shard streams past in blocks, and only the
best k of each query leave the group. Per-query lists then merge in a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from codelode.llm.common import cut_lineage, segments

#: Queries of a tile, candidates of a shard, and lists merged at once.
QUERIES, SHARD, FAN_IN = 1024, 16384, 32


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component as double; rows with null or non-finite parts go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(scale))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum fits their 53 bits, else in 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _keep(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k columns of each row, larger scores first and smaller ids on ties."""
    if scores.shape[1] > k:
        # Everything above the k-th score stays, and of its equals the smallest ids.
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        rank = np.where(scores > edge, 2, (scores == edge).astype(np.int64))
        order = np.argsort(ids, axis=1, kind="stable")
        sorted_rank = np.take_along_axis(rank, order, 1)
        need = k - (sorted_rank == 2).sum(1, keepdims=True)
        take = (sorted_rank == 2) | ((sorted_rank == 1) & (np.cumsum(sorted_rank == 1, axis=1) <= need))
        at = order[take].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, ~scores), axis=1)  # ~ turns the order without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _best(k: int):
    none = np.int64(np.iinfo(np.int64).min)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, queries, top, top_ids, shard = None, None, None, None, None, None

        def lists() -> Iterator[pa.RecordBatch]:
            if top is not None:
                row, at = np.nonzero(top_ids != none)
                yield pa.record_batch([pa.array(ids[row]), pa.array(top_ids[row, at]), pa.array(top[row, at]), pa.array(np.full(len(row), shard))], names=["query_id", "vec_id", "score", "shard"])

        for now, is_query, rows in segments(batches, ["width", "tile", "shard"], "role"):
            if now != key:
                yield from lists()
                key, shard, ids, queries, top = now, now[2], None, None, None
            found, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"))
            if is_query:
                ids = found if ids is None else np.concatenate([ids, found])
                queries = v if queries is None else np.concatenate([queries, v])
                continue
            if ids is None:
                continue
            if top is None:
                top, top_ids = np.full((len(ids), 0), 0, np.int64), np.full((len(ids), 0), 0, np.int64)
            for at in range(0, len(found), 2048):
                part, part_ids = v[at : at + 2048], found[at : at + 2048]
                order = np.argsort(part_ids, kind="stable")
                part, part_ids = part[order], part_ids[order]
                new, new_ids = [], []
                for q in range(0, len(ids), 256):
                    scores = _scores(queries[q : q + 256], part)
                    mine = part_ids[None, :] == ids[q : q + 256, None]
                    names = np.where(mine, none, np.broadcast_to(part_ids, scores.shape))
                    scores[mine] = none
                    s, i = _block_best(scores, names, k)
                    s, i = _keep(np.concatenate([top[q : q + 256], s], 1), np.concatenate([top_ids[q : q + 256], i], 1), k)
                    new.append(s)
                    new_ids.append(i)
                top, top_ids = np.concatenate(new), np.concatenate(new_ids)
        yield from lists()

    return run


def _block_best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of a block whose columns go up by id: one partial selection on (score, -column) where that fits 63 bits."""
    n = scores.shape[1]
    if n <= k:
        return scores, names
    real = np.where(names == np.iinfo(np.int64).min, 0, scores)
    if float(np.abs(real).max(initial=0)) * n < 2.0**61:
        code = np.where(names == np.iinfo(np.int64).min, np.int64(-(2**62)), real * n) + (n - 1 - np.arange(n))
        at = np.argpartition(code, n - k, axis=1)[:, -k:]
        return np.take_along_axis(scores, at, 1), np.take_along_axis(names, at, 1)
    return _keep(scores, names, k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k best other rows.

    The score is the inner product of floor(scale * x), ties to the smaller id; a query has fewer rows where fewer
    candidates exist. Vectors that are null or hold null or non-finite parts take no part, nor do rows without an id;
    vectors of different lengths never meet; sums beyond 64 bits wrap. Repeated rows are candidates and queries each
    for themselves, but not of their own id; a repeated query gives one list. An empty table gives no rows.
    """
    whole = cut_lineage(whole_numbers(vectors, id_col, vector_col, scale).where("vec_id IS NOT NULL").withColumn("width", F.size("v")))
    n = whole.count()
    tiles, shards = -(-n // (every * QUERIES)) or 1, -(-n // SHARD) or 1
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    every_tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    queries = whole.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    queries = queries.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).withColumn("shard", every_shard).withColumn("role", F.lit(0))
    others = whole.withColumn("tile", every_tile).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("role", F.lit(1))
    dealt = queries.select("width", "tile", "shard", "role", "vec_id", "v").unionAll(others.select("width", "tile", "shard", "role", "vec_id", "v"))
    lists = dealt.repartition("width", "tile", "shard").sortWithinPartitions("width", "tile", "shard", "role").mapInArrow(_best(k), "query_id bigint, vec_id bigint, score bigint, shard int")
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*best)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
