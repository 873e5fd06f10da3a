"""Current run status per repository from a stream of run events (STR-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TERMINAL = ("completed", "failed")


def run_status_stream(runs: DataFrame) -> DataFrame:
    """STR-2: newest status per repository; works on a stream and on a table.

    State is one small row per repository, so no watermark is needed.
    """
    newest = F.struct("created_at", "id")
    return runs.groupBy("repository_id").agg(
        F.max_by("status", newest).alias("status"),
        F.max("created_at").alias("changed_at"),
    ).withColumn("terminal", F.col("status").isin(*TERMINAL))
