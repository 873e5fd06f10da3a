"""Merging and scoring candidates (JN-1, RET-4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode import fixed
from codelode.functions import text as tx
from codelode.operators.ranking import top_k
from codelode.session import maybe_broadcast, store

SCOPE = ["repository_id", "ingestion_id"]
# Candidate keys that a filter may have: 16 MB of bits in every task.
FILTER_KEYS = 1 << 23

# Lists are merged in this order; a chunk's place is where it is first seen.
SEMANTIC, OVERVIEW, KEYWORD = 0, 1, 2


def candidate_list(found: DataFrame, source: int) -> DataFrame:
    """One retriever's rows in the common shape."""
    zero = F.lit(0.0)
    lexical = source == KEYWORD
    return found.select(
        "query_id",
        "chunk_id",
        (zero if lexical else F.col("sem_score")).alias("sem_score"),
        (F.col("lex_score") if lexical else zero).alias("lex_score"),
        F.lit(source).alias("source"),
        F.col("rank").alias("source_rank"),
    )


def merge_candidates(*lists: DataFrame) -> DataFrame:
    """JN-1, SET-1, WIN-8: one row per (query, chunk) with its place in the lists."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("query_id", "chunk_id").agg(
        F.max("sem_score").alias("sem_score"),
        F.max("lex_score").alias("lex_score"),
        F.min(F.struct("source", "source_rank")).alias("first_seen"),
    )


def with_candidate_keys(chunks: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """Rows of ``chunks`` whose id may be among ``count`` candidate ``keys(chunk_id)``: all of those and about one in 50 others.

    A bit map of 16 bits a key, two of them set for each, goes to every task; only ids go to the Python worker, texts stay.
    """
    bits = 1 << max(10, (16 * count - 1).bit_length())
    hashed = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64("chunk_id", F.lit(i)), F.lit(bits)) for i in (1, 2)])).alias("at"))
    words = hashed.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toPandas()
    found = np.zeros(bits >> 6, np.int64)
    found[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = chunks.sparkSession.sparkContext.broadcast(found.view(np.uint64))

    @F.pandas_udf("boolean")
    def may_be(first: pd.Series, second: pd.Series) -> pd.Series:
        held, passed = shared.value, np.ones(len(first), bool)
        for at in (first.to_numpy(np.int64), second.to_numpy(np.int64)):
            passed &= (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(passed)

    places = [F.pmod(F.xxhash64("chunk_id", F.lit(i)), F.lit(bits)) for i in (1, 2)]
    return chunks.where(may_be(*places))


def fuse(merged: DataFrame, queries: DataFrame, chunks: DataFrame, small: bool = False) -> DataFrame:
    """RET-4: scored, filtered and ranked candidates with their chunk columns.

    ``chunks`` text is read only here, for the few candidate rows: candidates
    meet chunks on repository, run and id. With few queries (``small``, checked)
    they are copied to every task; else they are stored, and a filter of their
    keys keeps the text of other chunks out of the shuffle, up to ``FILTER_KEYS``.
    """
    asked = queries.select("query_id", *SCOPE, "query", "top_k", "min_score")
    if small:
        placed = maybe_broadcast(merged.join(maybe_broadcast(asked, True), "query_id"), True)
    else:
        placed = store(merged.join(asked, "query_id"), "candidates")
        keys = placed.select("chunk_id").distinct()
        count = keys.count()
        if count <= FILTER_KEYS:
            chunks = with_candidate_keys(chunks, keys, count)
    rows = chunks.join(placed, [*SCOPE, "chunk_id"])
    path, name, query = F.col("file_path"), F.col("name"), F.col("query")
    lowered = F.lower(tx.strip(query))
    symbol = F.coalesce((name != "") & (F.lower(name) == lowered), F.lit(False))
    evidence = symbol | ~tx.is_non_evidence(F.col("chunk_text"), path, query)
    overview = tx.is_broad_question(query) & tx.is_overview_chunk(path, name, F.col("start_line"))
    content = F.col("sem_score") * fixed.WEIGHT_SEMANTIC + F.col("lex_score") * fixed.WEIGHT_LEXICAL
    # The path bonus sees the lower-cased query, so camel case does not split here.
    on_path = (content >= fixed.PATH_BONUS_MIN_CONTENT) & tx.path_matches_query(path, lowered)
    bonus = (
        F.when(F.col("symbol"), fixed.BONUS_SYMBOL).otherwise(0.0)
        + F.when(on_path, fixed.BONUS_PATH).otherwise(0.0)
        + F.when(F.col("overview"), fixed.BONUS_OVERVIEW).otherwise(0.0)
    )
    # SET-3: sources in a fixed order.
    sources = F.array_compact(
        F.array(
            F.when(F.col("sem_score") > 0, "semantic"),
            F.when((F.col("lex_score") > 0) | F.col("symbol"), "keyword"),
            F.when(F.col("overview"), "overview"),
        )
    )
    scored = (
        rows.where(evidence)
        .withColumn("symbol", symbol)
        .withColumn("overview", overview)
        .withColumn("raw_score", F.least(F.lit(1.0), content + bonus))
        .withColumn("retrieval_sources", sources)
        .where(F.col("min_score").isNull() | (F.col("raw_score") >= F.col("min_score")))
    )
    order = [F.col("raw_score").desc(), F.col("first_seen"), F.col("chunk_id")]
    # A query has two lists of twice its limit and the overview list, no more.
    best = top_k(scored, ["query_id"], order, None, F.col("top_k"))
    return best.select(
        "query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "language",
        F.coalesce("chunk_type", F.lit("block")).alias("chunk_type"),
        "name", "chunk_text", F.round("raw_score", 6).alias("score"), "retrieval_sources",
    )
