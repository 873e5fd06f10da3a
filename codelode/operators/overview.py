"""Structural candidates for broad questions (RET-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelode import fixed
from codelode.functions import text as tx, vectors as vx
from codelode.operators.ranking import top_k

SCOPE = ["repository_id", "ingestion_id"]


def overview_chunks(chunks: DataFrame, limit: int = fixed.OVERVIEW_LIMIT) -> DataFrame:
    """SRT-3: the first overview chunks of each run; does not depend on any query."""
    found = chunks.where(
        tx.is_overview_chunk(F.col("file_path"), F.col("name"), F.col("start_line"))
    ).select(*SCOPE, "chunk_id", "file_path", "start_line", "embedding")
    order = [
        tx.overview_rank(F.col("file_path")),
        F.lower("file_path"),
        F.col("start_line"),
        F.col("chunk_id"),
    ]
    return top_k(found, SCOPE, order, limit)


def overview_search(
    queries: DataFrame, chunks: DataFrame, limit: int = fixed.OVERVIEW_LIMIT
) -> DataFrame:
    """RET-3: ``(query_id, chunk_id, sem_score, rank)`` for broad, unfiltered queries."""
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    broad = queries.where(
        tx.is_broad_question(F.col("query")) & free("file_extensions") & free("file_paths")
    ).select("query_id", *SCOPE, "query_vector")
    # Only the runs that a broad query asks about are looked at.
    scoped = chunks.join(broad.select(*SCOPE).distinct(), SCOPE, "left_semi")
    met = overview_chunks(scoped, limit).join(broad, SCOPE)
    both = F.col("query_vector").isNotNull() & F.col("embedding").isNotNull()
    cosine = F.round(vx.cosine(F.col("query_vector"), F.col("embedding")), 12)
    score = F.when(both, cosine).otherwise(F.lit(0.0))
    return met.select("query_id", "chunk_id", score.alias("sem_score"), "rank")
