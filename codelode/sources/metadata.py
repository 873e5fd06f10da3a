"""Repository descriptions as JSON texts (SRC-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_PLAIN = (
    "id bigint, name string, full_name string, description string, default_branch string, "
    "language string, stargazers_count int, forks_count int, open_issues_count int, "
    "updated_at timestamp"
)
_REQUIRED = ("id", "name", "full_name", "default_branch")
_COUNTS = ("stargazers_count", "forks_count", "open_issues_count")


def parse_repo_metadata(df: DataFrame, json_col: str, key: str = "id") -> DataFrame:
    """SRC-3: flat columns per row, with ``error`` set where the text is unusable.

    ``owner`` may be an object with a login or a plain string.
    """
    text = F.col(json_col)
    plain = F.from_json(text, f"{_PLAIN}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = df.select(key, text.alias("_text"), plain.alias("_m"))
    nested = F.get_json_object("_text", "$.owner.login")
    as_object = F.get_json_object("_text", "$.owner").startswith("{")
    owner = F.when(as_object, F.coalesce(nested, F.lit(""))).otherwise(
        F.get_json_object("_text", "$.owner")
    )
    missing = F.col("_m.id").isNull() | owner.isNull()
    for name in _REQUIRED[1:]:
        missing = missing | F.col(f"_m.{name}").isNull()
    error = F.when(
        F.col("_text").isNull() | F.col("_m").isNull() | F.col("_m._bad").isNotNull(), "malformed"
    ).when(missing, "missing_field")
    rows = rows.withColumn("error", error).withColumn("owner_login", owner)
    ok = F.col("error").isNull()
    columns = [F.when(ok, F.col("_m.id")).alias("github_id"), F.when(ok, F.col("owner_login")).alias("owner_login")]
    for name in ("name", "full_name", "description", "default_branch", "language"):
        columns.append(F.when(ok, F.col(f"_m.{name}")).alias(name))
    for name in _COUNTS:
        columns.append(F.when(ok, F.coalesce(f"_m.{name}", F.lit(0))).alias(name))
    columns.append(F.when(ok, F.col("_m.updated_at")).alias("updated_at"))
    return rows.select(key, *columns, "error")
