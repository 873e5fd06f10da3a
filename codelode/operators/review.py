"""Structured findings from free-form review texts (REV-1 to REV-3, JN-7, JN-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions import text as tx

_FENCE = r"(?md)^```(?:json)?(?U:\s*)|(?U:\s*)```$"
_TEXT_FIELDS = ("severity", "category", "explanation", "recommendation", "file_path")
_LINE_FIELDS = ("start_line", "end_line")


def _kind(value: Column) -> Column:
    """JSON type name: ``STRING``, ``BIGINT``, ``ARRAY<...>``, ``OBJECT<...>``, ..."""
    return F.schema_of_variant(value)


def _child(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _string(value: Column, path: str) -> Column:
    """The string at ``path``; NULL for another type or a blank string."""
    child = _child(value, path)
    text = F.when(_kind(child) == "STRING", F.try_variant_get(value, path, "string"))
    return F.when(tx.has_text(text), text)


def _integer(value: Column, path: str) -> Column:
    child = _child(value, path)
    return F.when(_kind(child) == "BIGINT", F.try_variant_get(value, path, "bigint"))


def parse_review(df: DataFrame, text: str = "text") -> DataFrame:
    """REV-1: add ``parsed`` (VARIANT object or NULL) and ``summary``."""
    raw = tx.strip(F.col(text))
    cleaned = tx.strip(F.regexp_replace(raw, _FENCE, ""))
    value = F.try_parse_json(cleaned)
    parsed = F.when(_kind(value).startswith("OBJECT"), value)
    return df.withColumn("parsed", parsed).withColumn(
        "summary", F.coalesce(_string(F.col("parsed"), "$.summary"), raw)
    )


def explode_findings(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """REV-2: one row per usable finding, numbered within its review.

    Items that are not objects or lack a title are left out; a field of the
    wrong type or a blank one is NULL.
    """
    found = _child(F.col("parsed"), "$.findings")
    rows = parsed.where(_kind(found).startswith("ARRAY")).select(
        key, F.posexplode(F.try_variant_get("parsed", "$.findings", "array<variant>")).alias("item", "value")
    )
    value = F.col("value")
    rows = rows.where(_kind(value).startswith("OBJECT"))
    sources = _child(value, "$.evidence_sources")
    numbers = F.when(
        _kind(sources).startswith("ARRAY"),
        F.transform(
            F.filter(
                F.try_variant_get(value, "$.evidence_sources", "array<variant>"),
                lambda v: F.schema_of_variant(v) == "BIGINT",
            ),
            lambda v: F.try_variant_get(v, "$", "bigint"),
        ),
    )
    empty = F.array().cast("array<bigint>")
    rows = rows.select(
        key,
        "item",
        _string(value, "$.title").alias("title"),
        *[_string(value, f"$.{f}").alias(f) for f in _TEXT_FIELDS],
        *[_integer(value, f"$.{f}").alias(f) for f in _LINE_FIELDS],
        F.coalesce(numbers, empty).alias("evidence_sources"),
    )
    return rows.where(F.col("title").isNotNull())


def finding_evidence(findings: DataFrame, evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """REV-3 and JN-7: the chunk behind each source number, in the order given.

    ``evidence(query_id, evidence_rank, chunk_id, ...)`` holds the used
    evidence; numbers beyond it are dropped. ``source_rank`` is a 1-based number.
    """
    cited = findings.select(
        key, "item", F.posexplode("evidence_sources").alias("place", "evidence_rank")
    )
    return cited.join(evidence, [key, "evidence_rank"])


def finding_cards(findings: DataFrame, evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """JN-8 and FN-14: each finding with its location and its supporting locations."""
    cited = finding_evidence(findings, evidence, key)
    span = F.concat(
        "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"),
    )
    # A finding cites at most as many sources as its own text lists.
    listed = cited.groupBy(key, "item").agg(
        F.array_sort(F.collect_list(F.struct("place", "chunk_id", span.alias("span")))).alias("_cited")
    )
    rows = findings.join(listed, [key, "item"], "left")
    none = F.array().cast("array<string>")
    return rows.select(
        key,
        "item",
        "title",
        "severity",
        "category",
        tx.location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("location"),
        F.coalesce(F.transform("_cited", lambda c: c["chunk_id"].cast("string")), none).alias(
            "evidence_chunk_ids"
        ),
        F.coalesce(F.transform("_cited", lambda c: c["span"]), none).alias("supported_by"),
    )
