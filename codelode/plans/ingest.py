"""Archives to run rows and chunks (RUN-2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from codelode import fixed
from codelode.operators import inverted
from codelode.operators.chunking import chunk_corpus
from codelode.operators.embedding import Embedder, embed, try_embed
from codelode.operators.keyword import build_postings
from codelode.operators.profile import profile_repository, scan_files
from codelode.session import is_small, maybe_broadcast, store
from codelode.sources.archives import ARCHIVE_ROWS, unpack
from codelode.sources.commits import CommitLog


@dataclass(frozen=True)
class Ingested:
    """Run rows, chunks of completed runs, and directory and file rows of every profiled run."""

    runs: DataFrame
    chunks: DataFrame
    directories: DataFrame
    files: DataFrame


def ingest(
    archives: DataFrame,
    fn: Embedder | None,
    run_ts: Column,
    apply_filter: bool = True,
    max_files: int = fixed.MAX_REPOSITORY_FILES,
    max_bytes: int = fixed.MAX_REPOSITORY_BYTES,
    profile_files: int | None = None,
    profile_bytes: int | None = None,
) -> Ingested:
    """RUN-2 on ``archives(repository_id, ingestion_id, content)``, one archive per repository and run.

    Every archive gives exactly one run row: ``failed`` with a message for a
    rejected archive or a breached limit, else ``completed``. Runs of one
    repository never mix. Only completed runs give chunks. ``max_files`` and
    ``max_bytes`` guard the unpacking of an archive; ``profile_files`` and
    ``profile_bytes`` limit its accepted files. ``fn`` None leaves the vectors out.
    """
    run = ["repository_id", "ingestion_id"]
    named = archives.withColumn("archive", F.to_json(F.struct(*run)))
    files, errors, ids = unpack(named, run, max_bytes, max_files)
    scanned = scan_files(files.select(F.col("archive").alias("repository_id"), "path", "length", "content"))
    profile = profile_repository(scanned, profile_files, profile_bytes)
    by_run = lambda df: ids.join(df.withColumnRenamed("repository_id", "archive"), "archive")
    profiles = profile.runs.withColumnRenamed("repository_id", "archive")
    shas = files.groupBy("archive").agg(F.max("commit_sha").alias("commit_sha"))
    rejected = errors.select("archive", F.col("message").alias("_rejected"))
    rows = (
        ids.join(profiles, "archive", "left")
        .join(shas, "archive", "left")
        .join(rejected, "archive", "left")
    )
    message = F.coalesce("_rejected", "error_message")
    status = F.when(message.isNotNull(), "failed").otherwise("completed")
    ok = message.isNull()
    # An archive whose files were all filtered out completes with zero totals.
    read = F.col("_rejected").isNull()
    zero = lambda c: F.when(read, F.coalesce(c, F.lit(0))).alias(c)
    runs = rows.select(
        F.col("ingestion_id").alias("id"),
        "repository_id",
        status.alias("status"),
        F.when(ok, F.col("commit_sha")).alias("commit_sha"),
        zero("file_count"),
        zero("total_size_bytes"),
        zero("total_lines"),
        "primary_language",
        "language_stats",
        message.alias("error_message"),
        run_ts.alias("completed_at"),
    )
    done = rows.where(ok).select("archive", *run)
    done = maybe_broadcast(done, is_small(done, ARCHIVE_ROWS))
    tree = files.drop("commit_sha").join(done, "archive").drop("archive")
    chunks = chunk_corpus(tree, apply_filter)
    if fn is not None:
        chunks = embed(chunks, "chunk_text", fn)
    listed = [by_run(df).drop("archive") for df in (profile.directories, profile.files)]
    return Ingested(runs, chunks, *listed)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_id``, which a repeated ingest of the same run gives again."""
    named = ("repository_id", "ingestion_id", "file_path", "start_line", "end_line", "chunk_type", "name", "content_hash")
    return chunks.withColumn("chunk_id", F.xxhash64(*named))


def ingest_into(
    log: CommitLog, archives: DataFrame, fn: Embedder | None, run_ts: Column, **options
) -> DataFrame:
    """RUN-2 with its writes: runs, repository status, chunks and their inverted index, in one commit.

    A run whose texts could not be embedded is completed all the same, without
    chunks, and its repository keeps the chunks that it has; a repository is
    ``ready`` after a completed run and ``failed`` after another. Returns
    ``(repository_id, ingestion_id, error)`` of the runs left without chunks.
    """
    run = ["repository_id", "ingestion_id"]
    made = ingest(archives, None, run_ts, **options)
    chunks = chunk_ids(made.chunks)
    runs = store(made.runs, "runs")
    if fn is None:
        failed = runs.select("repository_id", F.col("id").alias("ingestion_id"), F.lit(None).cast("string").alias("error")).limit(0)
    else:
        chunks = store(try_embed(chunks, "chunk_text", fn), "chunks")
        failed = chunks.where("embed_error IS NOT NULL").groupBy(*run).agg(F.min("embed_error").alias("error"))
        failed = store(failed, "not-embedded")
        chunks = chunks.drop("embed_error").join(failed.select(*run), run, "left_anti")
    newest = runs.groupBy("repository_id").agg(F.max_by("status", "id").alias("status"))
    status = F.when(F.col("status") == "completed", "ready").otherwise("failed")
    log.commit(
        {
            "runs": runs,
            "repository_status": newest.select("repository_id", status.alias("status")),
            "chunks": chunks,
            # From the chunks as this commit has written them.
            "postings": lambda made: inverted.posting_lists(build_postings(made["chunks"], by_chunk=True), made["chunks"]),
        },
        dealt=["postings"],
    )
    return failed
