"""Approximate vector retrieval (RET-6).

Chunks are grouped around k-means centroids; a query is scored only against
the chunks of its nearest groups, with the exact scorer of RET-1. Probing all
groups gives the exact answer. Groups are only a way to skip rows: no group is
ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codelode import fixed
from codelode.functions import vectors as vx
from codelode.operators.ranking import top_k
from codelode.operators.semantic import semantic_scores
from codelode.session import BROADCAST_ROWS


@dataclass(frozen=True)
class VectorGroups:
    """Unit centroids; ``count`` times the vector width is small by choice."""

    centroids: np.ndarray

    @property
    def count(self) -> int:
        return len(self.centroids)


def fit_groups(chunks: DataFrame, count: int, seed: int = 7, rounds: int = 10) -> VectorGroups:
    """Train on every stored vector that is not NULL or zero."""
    unit = vx.l2_normalize(F.col("embedding"))
    rows = chunks.where(F.col("embedding").isNotNull() & (vx.norm(F.col("embedding")) > 0))
    rows = rows.select(array_to_vector(unit).alias("features"))
    model = KMeans(k=count, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows)
    centers = np.array(model.clusterCenters())
    return VectorGroups(centers / np.linalg.norm(centers, axis=1, keepdims=True))


def nearest_groups(groups: VectorGroups, vector: Column, probes: int) -> Column:
    """Numbers of the ``probes`` centroids nearest to ``vector``, nearest first."""
    centroids = groups.centroids

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            matrix = np.stack(vectors.to_numpy()).astype(np.float64)
            order = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes]
            yield pd.Series(list(order.astype(np.int32)))

    return near(vector)


def approx_semantic_search(
    queries: DataFrame,
    chunks: DataFrame,
    groups: VectorGroups,
    probes: int,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """RET-6: the columns of ``semantic_search``, from the ``probes`` nearest groups."""
    stored = chunks.where(F.col("embedding").isNotNull())
    stored = stored.withColumn("_group", nearest_groups(groups, F.col("embedding"), 1)[0])
    asked = queries.where(F.col("query_vector").isNotNull())
    asked = asked.withColumn(
        "_group", F.explode(nearest_groups(groups, F.col("query_vector"), probes))
    )
    # A group narrows the run that is searched.
    narrowed = F.concat_ws("/", F.col("ingestion_id").cast("string"), F.col("_group"))
    partial = semantic_scores(
        asked.withColumn("ingestion_id", narrowed),
        stored.withColumn("ingestion_id", narrowed),
        broadcast_rows,
    )
    most = fixed.CANDIDATE_FACTOR * fixed.MAX_TOP_K
    order = [F.col("sem_score").desc(), F.col("chunk_id")]
    best = top_k(partial, ["query_id"], order, most)
    return best.join(queries.select("query_id", "candidate_k"), "query_id").where(
        F.col("rank") <= F.col("candidate_k")
    ).drop("candidate_k")
