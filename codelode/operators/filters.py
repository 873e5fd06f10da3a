"""File and request filters (FLT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode import fixed
from codelode.functions import text as tx


def file_verdict(
    files: DataFrame, max_bytes: int | None = fixed.MAX_FILE_BYTES, check_content: bool = True
) -> DataFrame:
    """FLT-6: add ``ignored`` and ``reason``; the first matching reason wins.

    ``files`` has ``path``, ``length`` and, with ``check_content``, ``content``.
    A NULL length stands for a file that could not be read; ``max_bytes`` None sets no size limit.
    """
    path, length = F.col("path"), F.col("length")
    reason = (
        F.when(tx.is_secret_file(path), "secret_or_credential_file")
        .when(tx.has_binary_extension(path), "binary_extension")
        .when(length.isNull(), "stat_error")
    )
    if max_bytes is not None:
        size = F.concat(F.lit("file_size_exceeded_"), length.cast("string"), F.lit("_bytes"))
        reason = reason.when(length > max_bytes, size)
    if check_content:
        unreadable = F.coalesce(tx.is_binary_content(F.col("content")), F.lit(True))
        reason = reason.when(unreadable, "binary_content")
    return files.withColumn("reason", reason).withColumn("ignored", F.col("reason").isNotNull())


def accepted_files(files: DataFrame, **options) -> DataFrame:
    """FLT-1 and FLT-6: files outside ignored directories with no reason to skip."""
    kept = files.where(~tx.in_ignored_dir(F.col("path")))
    return file_verdict(kept, **options).where(~F.col("ignored")).drop("ignored", "reason")


def by_extension(chunks: DataFrame, extensions: list[str] | None) -> DataFrame:
    """FLT-7: literal suffixes, pushed to the scan; no list means no filter."""
    if not extensions:
        return chunks
    keep = F.lit(False)
    for ext in extensions:
        keep = keep | F.col("file_path").endswith(ext if ext.startswith(".") else f".{ext}")
    return chunks.where(keep)


def by_path_prefix(chunks: DataFrame, prefixes: list[str] | None) -> DataFrame:
    """FLT-8: literal prefixes, in which ``_`` and ``%`` are wildcards."""
    if not prefixes:
        return chunks
    keep = F.lit(False)
    for prefix in prefixes:
        keep = keep | F.col("file_path").like(f"{prefix}%")
    return chunks.where(keep)


def scope(df: DataFrame, **equal) -> DataFrame:
    """FLT-9: equality on scoping columns (owner, repository, run)."""
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def min_score(df: DataFrame, lowest: Column | float) -> DataFrame:
    """FLT-12: keeps a score equal to the bound; a NULL bound keeps all."""
    bound = lowest if isinstance(lowest, Column) else F.lit(lowest)
    return df.where(bound.isNull() | (F.col("score") >= bound))


def non_blank(df: DataFrame, column: str = "chunk_text") -> DataFrame:
    """FLT-13."""
    return df.where(tx.has_text(F.col(column)))


def _too_long(name: str, limit: int) -> tuple[Column, str]:
    return F.length(name) > limit, f"{name}_too_long"


def _request_rules(columns: set[str], max_top_k: int) -> list[tuple[Column, str]]:
    rules: list[tuple[Column, str]] = []

    def col(name: str) -> Column:
        return F.col(name)

    for name, limit in (("query", fixed.QUERY_CHARS), ("message", fixed.QUESTION_CHARS)):
        if name in columns:
            rules += [(col(name).isNull() | (col(name) == ""), f"{name}_empty"), _too_long(name, limit)]
    if "top_k" in columns:
        rules.append((~col("top_k").between(1, max_top_k), "top_k_out_of_range"))
    if "min_score" in columns:
        rules.append((~col("min_score").between(0.0, 1.0), "min_score_out_of_range"))
    if "mode" in columns:
        rules.append((~col("mode").isin(*fixed.RETRIEVAL_MODES), "mode_unknown"))
    if "focus" in columns:
        rules.append((~col("focus").isin(*fixed.REVIEW_FOCUSES), "focus_unknown"))
    for name in ("file_extensions", "file_paths"):
        if name in columns:
            rules.append((F.size(name) > fixed.MAX_FILTER_VALUES, f"{name}_too_many"))
    if "user_code" in columns:
        rules.append(_too_long("user_code", fixed.USER_CODE_CHARS))
    for name in ("start_line", "end_line"):
        if name in columns:
            rules.append((col(name) < 1, f"{name}_below_one"))
    if {"start_line", "end_line"} <= columns:
        rules.append((col("end_line") < col("start_line"), "line_range_inverted"))
    if {"file_path", "user_code"} <= columns:
        empty = lambda n: F.coalesce(col(n), F.lit("")) == ""
        rules.append((empty("file_path") & empty("user_code"), "no_review_target"))
    return rules


def validate_requests(requests: DataFrame, max_top_k: int = fixed.MAX_TOP_K) -> DataFrame:
    """FLT-14: add ``errors`` and ``valid``, checking whichever columns exist."""
    rules = _request_rules(set(requests.columns), max_top_k)
    errors = F.array_compact(F.array(*[F.when(bad, code) for bad, code in rules]))
    return requests.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
