"""Stored vector lists with product-quantised codes (RET-6).

Vectors lie in lists around centroids, and the list's number is a partition column of the stored table, so a search opens the
folders of the lists that it probes and no others. Beside each vector stands its code: the unit vector less its centroid, cut
into sub-spaces, each given by its nearest entry in that sub-space's codebook. A search reads codes first, some tens of bytes
a row, and estimates scores with one table lookup per sub-space; only the best rows' vectors are fetched and scored exactly.
With all lists and no cut after the codes the answer is that of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from codelode.functions import vectors as vx
from codelode.functions.text import dotted
from codelode.operators.ranking import top_k
from codelode.operators.semantic import _allowed, _best, _id_array, _matrix, _unit_rows, _vectors

SCOPE = ["repository_id", "ingestion_id"]
#: Vectors that the centroids and codebooks are fitted on, at most, and rounds of fitting. Every vector gets a list and a code.
SAMPLE, ROUNDS = 8_192, 12
#: Queries whose tables go to every task together; entries of a codebook.
TOGETHER, CODES = 256, 256


@dataclass(frozen=True)
class VectorLists:
    """Unit centroids of the lists, and a codebook of each sub-space; its size is set by the caller, not by the data."""

    centroids: np.ndarray
    books: np.ndarray  # (sub-spaces, entries, width of a sub-space)

    def nearest(self, units: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(units @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def encode(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self._parts(units - self.centroids[lists])
        return np.stack([_nearest_entry(rest[:, j], book) for j, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, units: np.ndarray) -> np.ndarray:
        """(queries, sub-spaces, entries): inner products of each query's part with each entry."""
        return np.einsum("qjw,jew->qje", self._parts(units), self.books)

    def _parts(self, matrix: np.ndarray) -> np.ndarray:
        spaces, _, width = self.books.shape
        padded = np.zeros((len(matrix), spaces * width))
        padded[:, : matrix.shape[1]] = matrix
        return padded.reshape(len(matrix), spaces, width)


def _nearest_entry(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * rows @ book.T, axis=1)


def _fit(rows: np.ndarray, count: int, draw: np.random.Generator) -> np.ndarray:
    """Centres of at most ``count`` groups of the rows."""
    centres = rows[draw.permutation(len(rows))[:count]]
    for _ in range(ROUNDS):
        near = _nearest_entry(rows, centres)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def fit_lists(chunks: DataFrame, count: int, spaces: int, seed: int = 7) -> VectorLists:
    """Fit ``count`` lists and ``spaces`` codebooks on at most about ``SAMPLE`` vectors, chosen by a hash of their ids."""
    stored = chunks.where(F.col("embedding").isNotNull() & (vx.norm(F.col("embedding")) > 0)).select("chunk_id", "embedding")
    share = min(1.0, SAMPLE / max(1, stored.count()))
    some = stored.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    units = _unit_rows(_matrix([r["embedding"] for r in some.orderBy("chunk_id").collect()]))
    if not len(units):
        raise ValueError("no vector to fit on")
    draw = np.random.default_rng(seed)
    centroids = _unit_rows(_fit(units, count, draw))
    width = -(-units.shape[1] // spaces)
    lists = VectorLists(centroids, np.zeros((spaces, 1, width)))
    rest = lists._parts(units - centroids[lists.nearest(units, 1)[:, 0]])
    books = [_fit(rest[:, j], min(CODES, len(units)), draw) for j in range(spaces)]
    return VectorLists(centroids, np.stack(books))


def coded(chunks: DataFrame, lists: VectorLists) -> DataFrame:
    """``chunks`` with a vector as (scope, chunk_id, file_path, embedding, code, list)."""
    rows = chunks.where(F.col("embedding").isNotNull()).select(*SCOPE, "chunk_id", "file_path", "embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _unit_rows(_vectors(batch.column("embedding")))
                near = lists.nearest(units, 1)[:, 0]
                codes = [c.tobytes() for c in lists.encode(units, near)]
                yield pa.record_batch([*batch.columns, pa.array(codes, pa.binary()), pa.array(near, pa.int32())], names=[*batch.schema.names, "code", "list"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, code binary, list int")


def write_lists(rows: DataFrame, target: str) -> None:
    """Store coded rows, one folder a list; large lists are split over several files by measured size."""
    rows.hint("rebalance", "list").sortWithinPartitions("list", *SCOPE).write.mode("overwrite").partitionBy("list").parquet(target)


def read_lists(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def _probes(asked: DataFrame, lists: VectorLists, probes: int) -> DataFrame:
    """The queries once for each list that they probe."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = lists.nearest(_unit_rows(_vectors(batch.column("query_vector"))), probes)
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.record_batch([*[c.take(at) for c in batch.columns], pa.array(near.ravel().astype(np.int32))], names=[*batch.schema.names, "list"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(run, f"{kinds}, list int")


def lists_search(queries: DataFrame, stored: DataFrame, lists: VectorLists, probes: int, refine: int | None = 8) -> DataFrame:
    """RET-6 on ``read_lists``: the columns of ``semantic_search``, from the ``probes`` nearest lists of each query.

    By codes, ``refine`` times ``candidate_k`` rows of a task are kept for each query, and those are scored exactly (None: all).
    Queries are taken in blocks of ``TOGETHER``; a block's tables go to every task, and it reads its own lists only.
    """
    asked = queries.where(F.col("query_vector").isNotNull()).select(
        "query_id", *SCOPE, "query_vector", F.col("candidate_k").cast("int").alias("candidate_k"),
        F.transform(F.col("file_extensions"), dotted).alias("file_extensions"), "file_paths",
    )
    found = None
    n = asked.count()
    blocks = max(1, -(-n // TOGETHER))
    for i in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)) == i)
        part = _search_block(mine, stored, lists, probes, refine, queries.schema["query_id"].dataType)
        found = part if found is None else found.unionByName(part)
    limited = found.join(queries.select("query_id", "candidate_k"), "query_id")
    return top_k(limited, ["query_id"], [F.col("sem_score").desc(), F.col("chunk_id")], None, F.col("candidate_k")).drop("candidate_k")


def _search_block(asked: DataFrame, stored: DataFrame, lists: VectorLists, probes: int, refine: int | None, id_type) -> DataFrame:
    rows = [r.asDict() for r in _probes(asked, lists, probes).collect()]  # a block's queries, ``probes`` times
    by_list: dict[tuple, list[dict]] = {}
    for row in rows:
        by_list.setdefault((row["list"], *(row[c] for c in SCOPE)), []).append(row)
    wanted = sorted({r["list"] for r in rows})
    opened = stored.where(F.col("list").isin(*wanted)) if wanted else stored.limit(0)
    chunk_type = stored.schema["chunk_id"].dataType
    kind = StructType([StructField("query_id", id_type), StructField("chunk_id", chunk_type), StructField("estimate", DoubleType()), StructField("list", stored.schema["list"].dataType)])
    arrow = to_arrow_schema(kind)

    def estimate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple] = {}
        tables: dict[tuple, tuple] = {}
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("list", *SCOPE)], strict=True))
            places: dict[tuple, list[int]] = {}
            for place, key in enumerate(keys):
                if key in by_list:
                    places.setdefault(key, []).append(place)
            for key, at in places.items():
                part = batch.take(pa.array(at))
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
                ids, paths = _id_array(part.column("chunk_id")), part.column("file_path").to_pylist()
                if key not in tables:
                    units = _unit_rows(_matrix([r["query_vector"] for r in by_list[key]]))
                    tables[key] = units @ lists.centroids[key[0]], lists.tables(units)
                base, looked = tables[key]
                for q, row in enumerate(by_list[key]):
                    scores = base[q] + looked[q][np.arange(codes.shape[1]), codes].sum(1)
                    mask = _allowed(paths, row["file_extensions"], row["file_paths"])
                    mine = (scores, ids) if mask is None else (scores[mask], ids[mask])
                    name = (row["query_id"], key[0])
                    if name in kept:
                        mine = tuple(np.concatenate(pair) for pair in zip(kept[name], mine, strict=True))
                    kept[name] = mine if refine is None else _best(*mine, refine * row["candidate_k"])
        for (query, number), (scores, ids) in kept.items():
            columns = [[query] * len(ids), [x.item() if isinstance(x, np.generic) else x for x in ids], scores, [number] * len(ids)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    near = opened.select("list", *SCOPE, "chunk_id", "file_path", "code").mapInArrow(estimate, kind)
    limits = asked.select("query_id", *SCOPE, "query_vector", "candidate_k")
    near = near.join(limits.select("query_id", "candidate_k"), "query_id")
    if refine is not None:
        near = top_k(near, ["query_id"], [F.col("estimate").desc(), F.col("chunk_id")], None, F.col("candidate_k") * refine)
    # Second read: the vectors of the rows that are left.
    pairs = near.select("query_id", "chunk_id", "list").join(limits.select("query_id", *SCOPE, "query_vector"), "query_id")
    both = opened.select("list", *SCOPE, "chunk_id", "embedding").join(pairs, ["list", *SCOPE, "chunk_id"])
    scored = StructType([kind["query_id"], kind["chunk_id"], StructField("sem_score", DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unit_rows(_vectors(batch.column(c))) for c in ("query_vector", "embedding"))
                if a.shape != b.shape:
                    raise ValueError("query and chunk vectors differ in width")
                products = np.round(np.clip(np.einsum("nd,nd->n", a, b), 0.0, 1.0), 12)
                yield pa.record_batch([batch.column("query_id"), batch.column("chunk_id"), pa.array(products)], names=["query_id", "chunk_id", "sem_score"])

    return both.select("query_id", "chunk_id", "query_vector", "embedding").mapInArrow(score, scored)
