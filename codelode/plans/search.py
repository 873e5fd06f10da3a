"""Answering a table of search requests (RET-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelode import fixed
from codelode.operators import fusion
from codelode.operators.filters import validate_requests
from codelode.operators.keyword import keyword_search
from codelode.operators.overview import overview_search
from codelode.operators.ranking import latest_run
from codelode.operators.semantic import semantic_search
from codelode.session import BROADCAST_ROWS, maybe_broadcast, pin_small

# Repositories that may be named one by one in a partition filter.
PRUNED_REPOSITORIES = 200

_DEFAULTS = {
    "top_k": ("int", 10),
    "mode": ("string", "hybrid"),
    "file_extensions": ("array<string>", None),
    "file_paths": ("array<string>", None),
    "min_score": ("double", None),
    "query_vector": ("array<float>", None),
}


def with_defaults(queries: DataFrame) -> DataFrame:
    """Fill request columns that the caller left out, or left NULL."""
    for name, (kind, value) in _DEFAULTS.items():
        default = F.lit(value).cast(kind)
        if name in queries.columns:
            queries = queries.withColumn(name, F.coalesce(F.col(name), default))
        else:
            queries = queries.withColumn(name, default)
    return queries.withColumn(
        "candidate_k", (F.col("top_k") * fixed.CANDIDATE_FACTOR).cast("int")
    )


def resolve_runs(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """JN-2, first half: the run each query reads, NULL where nothing is indexed."""
    current = latest_run(runs).select("repository_id", F.col("id").alias("ingestion_id"))
    return queries.join(current, "repository_id", "left")


def not_indexed(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """Queries against repositories that have no completed run."""
    rows = resolve_runs(queries, runs).where(F.col("ingestion_id").isNull())
    return rows.select("query_id", "repository_id", F.lit("not_indexed").alias("status"))


def answer_requests(
    queries: DataFrame,
    chunks: DataFrame,
    runs: DataFrame,
    max_top_k: int = fixed.MAX_TOP_K,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """RET-5 for requests of any kind: (ranked chunks, refused requests).

    FLT-14 decides which requests are valid; the others come back as
    ``(query_id, repository_id, errors)`` and keep no valid one from its answer.
    """
    checked = validate_requests(with_defaults(queries), max_top_k)
    refused = checked.where(~F.col("valid")).select("query_id", "repository_id", "errors")
    good = checked.where("valid").drop("errors", "valid", "candidate_k")
    return search(good, chunks, runs, **options), refused


def search(
    queries: DataFrame,
    chunks: DataFrame,
    runs: DataFrame,
    postings: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    index: DataFrame | None = None,
) -> DataFrame:
    """RET-5: ranked chunks per query.

    ``queries(query_id, repository_id, query, query_vector, ...)`` holds valid
    requests; see ``answer_requests``. ``not_indexed`` lists the queries that
    cannot be answered. With ``index`` (``inverted.read_index`` or the
    ``postings`` of a commit log) words are looked up, not read from the texts.
    """
    resolved = resolve_runs(with_defaults(queries), runs)
    asked, small = pin_small(
        resolved.where(F.col("ingestion_id").isNotNull()), broadcast_rows
    )
    asked_scopes = asked.select("repository_id", "ingestion_id").distinct()
    if small:
        # Literal values prune the folders of a partitioned chunk table at planning time.
        ids = sorted({r.repository_id for r in asked.select("repository_id").collect()})
        if len(ids) <= PRUNED_REPOSITORIES:
            chunks = chunks.where(F.col("repository_id").isin(*ids))
    # Only the asked runs are read.
    scoped = chunks.join(
        maybe_broadcast(asked_scopes, small), ["repository_id", "ingestion_id"], "left_semi"
    )
    wants = lambda *modes: asked.where(F.col("mode").isin(*modes))
    semantic = semantic_search(wants("hybrid", "semantic"), scoped, broadcast_rows)
    keyword = keyword_search(wants("hybrid", "keyword"), scoped, postings, small, index)
    # A keyword-only search has no query vector, so its overview rows score 0.
    vector = F.when(F.col("mode") != "keyword", F.col("query_vector"))
    overview = overview_search(asked.withColumn("query_vector", vector), scoped)
    merged = fusion.merge_candidates(
        fusion.candidate_list(semantic, fusion.SEMANTIC),
        fusion.candidate_list(overview, fusion.OVERVIEW),
        fusion.candidate_list(keyword, fusion.KEYWORD),
    )
    return fusion.fuse(merged, asked, scoped, small)
