"""Vector retrieval (RET-1, RET-6).

Every chunk of the run is scored for every query of its repository, but no
pair leaves the task that scored it: each task keeps the best ``candidate_k``
per query and the shuffle carries only those. Scoring is a matrix product over
Arrow batches, because a 1,024-term sum per pair is what BLAS does best.

Few queries (checked) are copied to every task and chunks are not shuffled at
all. Otherwise chunks and queries meet in cells of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from codelode.functions.text import dotted
from codelode.operators.ranking import top_k
from codelode.session import BROADCAST_ROWS, is_small, maybe_broadcast

SCOPE = ["repository_id", "ingestion_id"]
CHUNK_CELL_ROWS = 32_768
QUERY_CELL_ROWS = 4_096
SCOPE_ROWS = 100_000
# Scores are compared to 12 places: the last bits of a matrix product depend on
# where a row falls in its block.
_PLACES = 12


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class _Prefix:
    """LIKE 'prefix%' where the prefix may hold wildcards."""

    def __init__(self, prefix: str):
        wild = {"%": ".*", "_": "."}
        body = "".join(wild.get(c, re.escape(c)) for c in prefix)
        self.match = re.compile(body, re.DOTALL).match if re.search("[%_]", prefix) else None
        self.prefix = prefix

    def __call__(self, path: str) -> bool:
        return bool(self.match(path)) if self.match else path.startswith(self.prefix)


def _allowed(paths: list[str], extensions, prefixes) -> np.ndarray | None:
    """Mask of the paths that pass both filters; None where nothing is filtered."""
    if not extensions and not prefixes:
        return None
    tests = [_Prefix(p) for p in prefixes or ()]
    ends = tuple(extensions or ())
    return np.array(
        [
            (not ends or p.endswith(ends)) and (not tests or any(t(p) for t in tests))
            for p in paths
        ],
        dtype=bool,
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores with their ids; ties go to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= floor
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class QueryBlock:
    """Queries of one repository run, and the best chunks each has met so far."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.units = _unit_rows(_matrix([r["query_vector"] for r in rows]))
        self.kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(rows)

    def meet(self, ids: np.ndarray, paths: list[str], vectors: np.ndarray) -> None:
        if vectors.shape[1] != self.units.shape[1]:
            raise ValueError("query and chunk vectors differ in width")
        products = self.units @ _unit_rows(vectors).T
        scores = np.round(np.clip(products, 0.0, 1.0), _PLACES)
        masks: dict[tuple, np.ndarray | None] = {}
        for i, row in enumerate(self.rows):
            key = (tuple(row["file_extensions"] or ()), tuple(row["file_paths"] or ()))
            if key not in masks:
                masks[key] = _allowed(paths, *key)
            mask = masks[key]
            mine = (scores[i], ids) if mask is None else (scores[i][mask], ids[mask])
            best = _best(*mine, row["candidate_k"])
            if self.kept[i] is not None:
                both = [np.concatenate(pair) for pair in zip(self.kept[i], best)]
                best = _best(*both, row["candidate_k"])
            self.kept[i] = best

    def results(self) -> Iterator[tuple]:
        for row, kept in zip(self.rows, self.kept):
            for score, chunk in zip(*(kept or ((), ()))):
                yield row["query_id"], chunk, float(score)


def _id_array(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=object)


def _vectors(column: pa.Array) -> np.ndarray:
    widths = set(column.value_lengths().to_pylist())
    if len(widths) != 1:
        raise ValueError(f"vectors of several widths: {sorted(widths)}; set them aside first")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), widths.pop())


def _emit(blocks: list[QueryBlock], schema: pa.Schema) -> pa.Table:
    rows = [r for b in blocks for r in b.results()]
    columns = list(zip(*rows)) or [(), (), ()]
    cast = [[v.item() if isinstance(v, np.generic) else v for v in c] for c in columns]
    return pa.table([pa.array(c, f.type) for c, f in zip(cast, schema)], schema=schema)


def _scan_with(
    grouped: dict[tuple, list[dict]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, QueryBlock] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*[table.column(c).to_pylist() for c in SCOPE]))
            places: dict[tuple, list[int]] = {}
            for place, key in enumerate(keys):
                places.setdefault(key, []).append(place)
            for key, rows in places.items():
                if key not in grouped:
                    continue
                block = blocks.setdefault(key, QueryBlock(grouped[key]))
                part = batch.take(pa.array(rows))
                block.meet(
                    _id_array(part.column("chunk_id")),
                    part.column("file_path").to_pylist(),
                    _vectors(part.column("embedding")),
                )
        yield from _emit(list(blocks.values()), schema).to_batches()

    return scan


def _meet_cell(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        blocks = []
        if len(queries) and len(chunks):
            block = QueryBlock(queries.to_pylist())
            chunks = chunks.combine_chunks()
            block.meet(
                _id_array(chunks.column("chunk_id").combine_chunks()),
                chunks.column("file_path").to_pylist(),
                _vectors(chunks.column("embedding").combine_chunks()),
            )
            blocks = [block]
        return _emit(blocks, schema)

    return meet


def _cell_counts(df: DataFrame, rows: int) -> DataFrame:
    """Cells per run so that a cell holds about ``rows`` rows; one small row per run."""
    counts = df.groupBy(*SCOPE).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_cells")
    )
    return maybe_broadcast(counts, is_small(counts, SCOPE_ROWS))


def _copy_to_cells(df: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Copy each row once per cell of the other side."""
    return df.join(counts, SCOPE).withColumn(
        name, F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    ).drop("_cells")


def _own_cell(df: DataFrame, id_col: str, counts: DataFrame, name: str) -> DataFrame:
    cell = F.pmod(F.xxhash64(id_col), F.col("_cells")).cast("int")
    return df.join(counts, SCOPE).withColumn(name, cell).drop("_cells")


def semantic_scores(
    queries: DataFrame, chunks: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per task or cell, the best ``candidate_k`` chunks of each query."""
    asked = queries.where(F.col("query_vector").isNotNull()).select(
        "query_id",
        *SCOPE,
        "query_vector",
        F.col("candidate_k").cast("int"),
        F.transform(F.col("file_extensions"), dotted).alias("file_extensions"),
        "file_paths",
    )
    stored = chunks.where(F.col("embedding").isNotNull()).select(
        *SCOPE, "chunk_id", "file_path", "embedding"
    )
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("sem_score", T.DoubleType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_out = to_arrow_schema(out)
    # At most one row beyond the bound reaches the driver.
    few = asked.limit(broadcast_rows + 1).collect()
    if len(few) <= broadcast_rows:
        grouped: dict[tuple, list[dict]] = {}
        for row in few:
            grouped.setdefault(tuple(row[c] for c in SCOPE), []).append(row.asDict())
        return stored.mapInArrow(_scan_with(grouped, arrow_out), out)

    cell = ["_query_cell", "_chunk_cell"]
    query_cells = _cell_counts(asked, QUERY_CELL_ROWS)
    chunk_cells = _cell_counts(stored, CHUNK_CELL_ROWS)
    left = _copy_to_cells(_own_cell(asked, "query_id", query_cells, cell[0]), chunk_cells, cell[1])
    right = _copy_to_cells(_own_cell(stored, "chunk_id", chunk_cells, cell[1]), query_cells, cell[0])
    return (
        left.groupBy(*SCOPE, *cell)
        .cogroup(right.groupBy(*SCOPE, *cell))
        .applyInArrow(_meet_cell(arrow_out), out)
    )


def semantic_search(
    queries: DataFrame, chunks: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """RET-1 (exact): ``(query_id, chunk_id, sem_score, rank)``.

    ``queries`` has ``query_vector``, ``candidate_k`` and the filter arrays;
    filters apply before the limit.
    """
    partial = semantic_scores(queries, chunks, broadcast_rows)
    limited = partial.join(queries.select("query_id", "candidate_k"), "query_id")
    order = [F.col("sem_score").desc(), F.col("chunk_id")]
    # Every task or cell has cut its rows to the query's own limit.
    return top_k(limited, ["query_id"], order, None, F.col("candidate_k")).drop("candidate_k")
