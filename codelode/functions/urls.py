"""Repository addresses (FN-12, FN-13)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codelode.functions.text import strip

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
HOST = "github.com"


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _without_git(name: Column) -> Column:
    return F.regexp_replace(name, r"\.git\z", "")


def _path(url: Column) -> Column:
    # Parameters after ';' belong to the last segment and are no part of the path.
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), r";[^/]*\z", "")


def normalize_repo_url(url: Column) -> Column:
    """FN-12: struct(url, owner, repo, reason); ``reason`` is NULL for a valid URL."""
    text = strip(url)
    netloc = F.regexp_extract(text, _PARTS, 2)
    host = F.substring_index(F.lower(netloc), ":", 1)
    parts = _segments(_path(text))
    owner = F.try_element_at(parts, F.lit(1))
    repo = _without_git(F.try_element_at(parts, F.lit(2)))
    reason = (
        F.when(url.isNull() | (text == ""), "empty")
        .when(F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]")), "malformed")
        .when(F.lower(F.regexp_extract(text, _PARTS, 1)) != "https", "scheme")
        .when(host != HOST, "host")
        .when(F.size(parts) < 2, "too_few_segments")
        .when(F.size(parts) > 2, "too_many_segments")
        .when(repo == "", "empty_name")
    )
    good = reason.isNull()
    return F.struct(
        F.when(good, F.concat(F.lit(f"https://{HOST}/"), owner, F.lit("/"), repo)).alias("url"),
        F.when(good, owner).alias("owner"),
        F.when(good, repo).alias("repo"),
        reason.alias("reason"),
    )


def full_name(url: Column, default: Column) -> Column:
    """FN-13."""
    parts = _segments(_path(url))
    named = F.concat(parts[0], F.lit("/"), _without_git(parts[1]))
    return F.when(F.size(parts) >= 2, named).otherwise(default)
