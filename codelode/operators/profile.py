"""Repository profiles (RUN-1, AGG-1 to AGG-6).

Every aggregate here combines on the map side, so one repository may hold any
share of all files. Directories and files stay rows; the only map has an entry
per known language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codelode import fixed
from codelode.functions import text as tx
from codelode.operators.filters import accepted_files
from codelode.operators.ranking import position
from codelode.session import store

KEY = "repository_id"


def scan_files(tree: DataFrame, **options) -> DataFrame:
    """Accepted files of a tree (``repository_id, path, length, content``) as catalog rows."""
    files = accepted_files(tree, **options)
    path = F.col("path")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        KEY,
        "path",
        tx.base_name(path).alias("name"),
        tx.suffix(path).alias("extension"),
        tx.detect_language(path).alias("language"),
        F.col("length").cast("long").alias("size_bytes"),
        tx.line_count(text).alias("line_count"),
    )


def repository_totals(catalog: DataFrame) -> DataFrame:
    """AGG-1."""
    return catalog.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("size_bytes").alias("total_size_bytes"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"),
    )


def language_rows(catalog: DataFrame) -> DataFrame:
    """AGG-2 as rows: one per repository and known language."""
    return (
        catalog.where(F.col("language").isNotNull())
        .groupBy(KEY, "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size_bytes").alias("bytes"),
            F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"),
        )
    )


def language_stats(languages: DataFrame) -> DataFrame:
    """AGG-2 and AGG-3 per repository, from ``language_rows``.

    The map has one entry per known language name, a fixed list. Equal byte
    counts go to the name that sorts first.
    """
    entry = F.struct("language", F.struct("files", "bytes", "lines").alias("stats"))
    first = F.min_by("language", F.struct((-F.col("bytes")).alias("most"), F.col("language")))
    return languages.groupBy(KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("language_stats"),
        first.alias("primary_language"),
    )


def primary_language(languages: DataFrame) -> DataFrame:
    """AGG-3 alone."""
    return language_stats(languages).select(KEY, "primary_language")


def directory_rows(catalog: DataFrame) -> DataFrame:
    """AGG-4 as rows: files per top-level directory."""
    return catalog.groupBy(KEY, tx.top_dir(F.col("path")).alias("directory")).agg(
        F.count(F.lit(1)).alias("files")
    )


def check_limits(
    totals: DataFrame, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """AGG-6: add ``error_message``, NULL for a repository within the given limits."""
    message = F.lit(None).cast("string")
    if max_bytes is not None:
        over = F.col("total_size_bytes") > max_bytes
        message = F.when(over, fixed.MSG_SIZE_LIMIT.format(max_bytes))
    if max_files is not None:
        over = F.col("file_count") > max_files
        message = F.when(over, fixed.MSG_FILE_LIMIT.format(max_files)).otherwise(message)
    return totals.withColumn("error_message", message)


def file_catalog(catalog: DataFrame) -> DataFrame:
    """AGG-5: catalog rows with their place by path in the repository, from 0."""
    return position(catalog, [KEY], ["path"], "place")


@dataclass(frozen=True)
class Profile:
    """``runs`` has a row per repository, ``directories`` one per directory, ``files`` one per file."""

    runs: DataFrame
    directories: DataFrame
    files: DataFrame


def profile_repository(
    catalog: DataFrame, max_files: int | None = None, max_bytes: int | None = None
) -> Profile:
    """RUN-1 from ``scan_files`` rows.

    The catalog rows are stored first, so that file contents are read once. A
    repository above a limit is marked ``failed`` and still profiled in full.
    """
    catalog = store(catalog, "catalog")
    totals = check_limits(repository_totals(catalog), max_files, max_bytes)
    runs = totals.join(language_stats(language_rows(catalog)), KEY, "left").select(
        KEY,
        F.when(F.col("error_message").isNull(), "completed").otherwise("failed").alias("status"),
        "file_count",
        "total_size_bytes",
        "total_lines",
        "primary_language",
        "language_stats",
        "error_message",
    )
    return Profile(runs, directory_rows(catalog), catalog)
