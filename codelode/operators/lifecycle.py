"""Repositories and runs (REP-1 to REP-3, RUN-3, JN-9 to JN-11, AGG-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode import fixed
from codelode.functions.urls import full_name, normalize_repo_url


def register(repositories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REP-1: (accepted rows, rejected rows with ``reason``).

    ``new(request_id, owner_id, name, github_url)``: addresses are normalised
    first; one owner keeps one registration per address, the earliest request
    of a batch winning (JN-9).
    """
    parsed = new.withColumn("_repo", normalize_repo_url(F.col("github_url")))
    bad = parsed.where(F.col("_repo.reason").isNotNull()).select(
        *new.columns, F.col("_repo.reason").alias("reason")
    )
    good = parsed.where(F.col("_repo.reason").isNull()).withColumn("github_url", F.col("_repo.url"))
    first = good.groupBy("owner_id", "github_url").agg(
        F.min("request_id").alias("request_id"),
    )
    seen = repositories.select("owner_id", "github_url").distinct()
    fresh = first.join(seen, ["owner_id", "github_url"], "left_anti")
    keys = ["owner_id", "github_url", "request_id"]
    accepted = good.join(fresh, keys, "left_semi").select(
        *new.columns,
        full_name(F.col("github_url"), F.col("name")).alias("full_name"),
        F.lit("pending").alias("status"),
    )
    repeated = good.join(fresh, keys, "left_anti").select(
        *new.columns, F.lit("already_registered").alias("reason")
    )
    return accepted, bad.unionByName(repeated)


_SYNCED = {
    "github_repository_id": "github_id",
    "github_owner": "owner_login",
    "name": "name",
    "full_name": "full_name",
    "description": "description",
    "primary_language": "language",
    "default_branch": "default_branch",
    "stars": "stargazers_count",
    "forks": "forks_count",
    "open_issues": "open_issues_count",
    "github_updated_at": "updated_at",
}


def sync(repositories: DataFrame, metadata: DataFrame, now: Column) -> DataFrame:
    """REP-2 and JN-10: take over fetched metadata, one row per repository.

    ``metadata(id, error, ...)`` comes from ``sources.metadata``. A row without
    an error replaces all synced columns, NULLs included, and sets ``ready``; an
    error sets ``failed`` and keeps them; other repositories do not change.
    """
    fresh = metadata.select(
        "id",
        F.lit(True).alias("_met"),
        F.col("error").isNull().alias("_ok"),
        *[F.col(src).alias(f"_{dst}") for dst, src in _SYNCED.items()],
    )
    rows = repositories.join(fresh, "id", "left")
    ok = F.coalesce("_ok", F.lit(False))
    met = F.coalesce("_met", F.lit(False))
    changed = {dst: F.when(ok, F.col(f"_{dst}")).otherwise(F.col(dst)) for dst in _SYNCED}
    url = normalize_repo_url(F.col("github_url"))["url"]
    changed["github_url"] = F.when(ok, F.coalesce(url, F.col("github_url"))).otherwise(
        F.col("github_url")
    )
    changed["status"] = (
        F.when(ok, "ready").when(met, "failed").otherwise(F.col("status"))
    )
    changed["last_synced_at"] = F.when(ok, now).otherwise(F.col("last_synced_at"))
    return rows.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in repositories.columns]
    )


def patch(repositories: DataFrame, updates: DataFrame) -> DataFrame:
    """REP-3: non-NULL fields of the update win; NULL never clears a value."""
    fields = [c for c in updates.columns if c != "id"]
    renamed = updates.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    rows = repositories.join(renamed, "id", "left")
    return rows.select(
        *[
            F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)
            for c in repositories.columns
        ]
    )


def sweep_runs(runs: DataFrame, now: Column) -> DataFrame:
    """RUN-3, first half: interrupted runs become failed ones."""
    stale = F.col("status") == "ingesting"
    rows = runs.withColumn("swept", stale)
    rows = rows.withColumn(
        "error_message", F.when(stale, fixed.MSG_SWEPT).otherwise(F.col("error_message"))
    )
    if "completed_at" in runs.columns:
        rows = rows.withColumn("completed_at", F.when(stale, now).otherwise(F.col("completed_at")))
    return rows.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def sweep_count(swept: DataFrame) -> DataFrame:
    """AGG-11."""
    return swept.agg(F.count_if("swept").alias("swept_count"))


def sweep_repositories(repositories: DataFrame, swept: DataFrame) -> DataFrame:
    """RUN-3 and JN-11: repositories still analyzing that have a swept run fail.

    Any run that ever failed this way counts, not only those of this sweep, and
    nothing changes when this sweep found no run.
    """
    if swept.where("swept").isEmpty():
        return repositories
    found = swept.where(
        (F.col("status") == "failed") & (F.col("error_message") == fixed.MSG_SWEPT)
    )
    hit = found.select(F.col("repository_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    rows = repositories.join(hit, "id", "left")
    failed = (F.col("status") == "analyzing") & F.coalesce("_hit", F.lit(False))
    return rows.withColumn("status", F.when(failed, "failed").otherwise(F.col("status"))).drop("_hit")


def restart_failed(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """JN-11 alone: repositories that have a restart-failed run."""
    found = runs.where(
        (F.col("status") == "failed") & (F.col("error_message") == fixed.MSG_SWEPT)
    ).select(F.col("repository_id").alias("id"))
    return repositories.join(found, "id", "left_semi")
