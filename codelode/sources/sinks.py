"""Chunk, run and message tables on Parquet (SNK-1, SNK-2, SNK-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.ranking import latest


def replace_chunks(new: DataFrame, target: str) -> None:
    """SNK-1: the new run's chunks take the place of all others of their repository.

    Repositories without new chunks keep theirs. ``new`` must not be derived
    from ``target``. Small repositories share a writing task and a large one is
    split over several, by measured size.
    """
    (
        new.hint("rebalance", "repository_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repository_id")
        .parquet(target)
    )


def append_rows(rows: DataFrame, target: str) -> None:
    """SNK-2 and SNK-3: add versions of run rows, or messages."""
    rows.write.mode("append").parquet(target)


def current_runs(spark: SparkSession, target: str, version: str = "updated_at") -> DataFrame:
    """SNK-2: the newest version of every run in the log."""
    return latest(spark.read.parquet(target), "id", [version])


def cascade_delete(
    ids: DataFrame,
    repositories: DataFrame,
    runs: DataFrame,
    chunks: DataFrame,
    conversations: DataFrame,
    messages: DataFrame,
) -> dict[str, DataFrame]:
    """SNK-4: what remains of each table without the repositories in ``ids(repository_id)``."""
    gone = ids.select("repository_id").distinct()
    dead = conversations.join(gone, "repository_id", "left_semi").select(
        F.col("id").alias("conversation_id")
    )
    return {
        "repositories": repositories.join(
            gone.withColumnRenamed("repository_id", "id"), "id", "left_anti"
        ),
        "runs": runs.join(gone, "repository_id", "left_anti"),
        "chunks": chunks.join(gone, "repository_id", "left_anti"),
        "conversations": conversations.join(gone, "repository_id", "left_anti"),
        "messages": messages.join(dead, "conversation_id", "left_anti"),
    }
