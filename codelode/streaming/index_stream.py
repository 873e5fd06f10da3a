"""Keeping the chunk table current from a stream of files (STR-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators.chunking import chunk_files


def index_stream(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """STR-1: chunk arriving files and add them to their run's chunks.

    ``files(repository_id, ingestion_id, file_path, language, text)`` is a
    streaming DataFrame; a run's files may arrive in any number of batches.
    Each batch writes folders of its own below its runs, so a batch that is
    replayed after a failure replaces only itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .hint("rebalance", "repository_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("repository_id", "ingestion_id", "batch_id")
            .parquet(target)
        )

    return (
        chunk_files(files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """STR-1: the chunks of each repository's newest run (the highest ``ingestion_id``)."""
    chunks = spark.read.parquet(target)
    newest = chunks.groupBy("repository_id").agg(F.max("ingestion_id").alias("ingestion_id"))
    return chunks.join(newest, ["repository_id", "ingestion_id"], "left_semi").drop("batch_id")
