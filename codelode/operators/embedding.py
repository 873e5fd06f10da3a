"""Attaching vectors to chunks (EMB-1 to EMB-4, WIN-7)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codelode import fixed
from codelode.functions import text as tx, vectors as vx
from codelode.operators.ranking import position, running_total

Embedder = Callable[[list[str]], list[list[float]]]
_VECTOR = T.ArrayType(T.FloatType())


def hash_coordinates(text: Column, width: int = fixed.EMBEDDING_WIDTH) -> Column:
    """EMB-2: a unit vector of doubles that depends on nothing but the text.

    The text is hashed once; a coordinate is a hash of its index and that
    digest, spread evenly over -1 to 1.
    """

    def coordinate(index: Column, whole: Column) -> Column:
        digest = F.md5(F.concat(index.cast("string"), F.lit(":"), whole).cast("binary"))
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        return number / F.lit(2.0**31) - F.lit(1.0)

    # The digest is an element of an array, so that it is worked out once a row and not once a coordinate.
    indexes = F.sequence(F.lit(0), F.lit(width - 1))
    whole = F.array(F.sha2(text.cast("binary"), 256))
    raw = F.flatten(F.transform(whole, lambda d: F.transform(indexes, lambda i: coordinate(i, d))))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda total, x: total + x * x))
    return F.transform(raw, lambda x: x / length)


def hash_embedding(width: int = fixed.EMBEDDING_WIDTH) -> Embedder:
    """EMB-2 as a function on texts, for callers that need an embedder."""

    def many(texts: list[str]) -> list[list[float]]:
        whole = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        digests = [[hashlib.md5(f"{i}:{d}".encode()).digest()[:4] for i in range(width)] for d in whole]
        raw = np.array([[int.from_bytes(d, "big") for d in row] for row in digests], float).reshape(len(texts), width)
        raw = raw / 2.0**31 - 1.0
        return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).tolist()

    return many


def embed(
    df: DataFrame,
    text_col: str,
    fn: Embedder,
    batch: int = fixed.EMBEDDING_SLICE,
    into: str = "embedding",
) -> DataFrame:
    """EMB-1: call ``fn`` on at most ``batch`` texts at a time, in row order."""

    @F.pandas_udf(_VECTOR)
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list[list[float]] = []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start : start + batch].tolist()
                found = fn(part)
                if len(found) != len(part):
                    raise ValueError("the embedding function must return one vector per text")
                out.extend(found)
            yield pd.Series(out)

    return df.withColumn(into, vectors(F.col(text_col)))


def try_embed(
    df: DataFrame,
    text_col: str,
    fn: Embedder,
    batch: int = fixed.EMBEDDING_SLICE,
) -> DataFrame:
    """EMB-1 for tables that must survive ``fn``: ``embedding``, and ``embed_error`` where a slice failed."""

    @F.pandas_udf("embedding array<float>, embed_error string")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            out, errors = [], []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start : start + batch].tolist()
                try:
                    found, error = fn(part), None
                    if len(found) != len(part):
                        found, error = [None] * len(part), "the embedding function must return one vector per text"
                except Exception as failure:  # whatever the caller's function raises is reported, not passed on
                    found, error = [None] * len(part), f"{type(failure).__name__}: {failure}"
                out += found
                errors += [error] * len(part)
            yield pd.DataFrame({"embedding": out, "embed_error": errors})

    return df.withColumn("_v", vectors(F.col(text_col))).select("*", "_v.embedding", "_v.embed_error").drop("_v")


def check_dimension(
    df: DataFrame, width: int = fixed.EMBEDDING_WIDTH, column: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """EMB-3: (rows of the right width, rows set aside)."""
    good = vx.has_width(F.col(column), width)
    return df.where(good), df.where(~good)


def _pack(tokens: Column, most_texts: int, most_tokens: int) -> Column:
    """0-based batch number of each element of an array of token counts."""
    state = F.struct(
        F.array().cast("array<int>").alias("batches"),
        F.lit(0).alias("batch"),
        F.lit(0).alias("texts"),
        F.lit(0).cast("long").alias("used"),
    )

    def step(s: Column, cost: Column) -> Column:
        full = (s["texts"] > 0) & (
            (s["used"] + cost > most_tokens) | (s["texts"] >= most_texts)
        )
        batch = s["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(
            F.array_append(s["batches"], batch).alias("batches"),
            batch.alias("batch"),
            F.when(full, 1).otherwise(s["texts"] + 1).alias("texts"),
            F.when(full, cost).otherwise(s["used"] + cost).cast("long").alias("used"),
        )

    return F.aggregate(tokens, state, step, lambda s: s["batches"])


def pack_slices(
    texts: DataFrame,
    keys: list[str],
    most_texts: int = fixed.EMBEDDING_BATCH_TEXTS,
    most_tokens: int = fixed.EMBEDDING_BATCH_TOKENS,
    slice_rows: int = fixed.EMBEDDING_SLICE,
) -> DataFrame:
    """WIN-7 on rows with ``position`` and ``tokens``: adds ``slice`` and ``batch``.

    Texts are handed over in slices of ``slice_rows``; only within a slice does
    a batch depend on the one before, so no list is longer than a slice.
    """
    sliced = texts.withColumn(
        "slice", F.floor(F.col("position") / slice_rows).cast("long")
    )
    entry = F.struct("position", "tokens")
    lists = sliced.groupBy(*keys, "slice").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    batches = _pack(F.transform("entries", lambda e: e["tokens"]), most_texts, most_tokens)
    rows = lists.withColumn("batches", batches)
    zipped = F.arrays_zip(F.col("entries.position"), F.col("entries.tokens"), F.col("batches"))
    return rows.select(*keys, "slice", F.inline(zipped).alias("position", "tokens", "batch"))


def batch_texts(
    df: DataFrame, keys: list[str], order: list[str], text_col: str = "chunk_text", **limits: int
) -> DataFrame:
    """WIN-7: number the texts of each key in ``order`` and pack them into batches."""
    sized = df.select(
        *keys, *order, tx.estimate_embedding_tokens(F.col(text_col)).alias("tokens")
    )
    placed = position(sized, keys, order)
    packed = pack_slices(placed.select(*keys, "position", "tokens"), keys, **limits)
    return placed.drop("tokens").join(packed, [*keys, "position"])


def spend_guard(
    batches: DataFrame,
    keys: list[str],
    order: list[str],
    tokens: str = "tokens",
    cap: int = fixed.EMBEDDING_SPEND_CAP,
) -> DataFrame:
    """EMB-4: add ``spent_before`` and ``allowed``.

    A batch is refused once earlier batches have used the cap; the batch that
    crosses it still runs.
    """
    rows = running_total(batches, keys, order, F.col(tokens).cast("long"), "spent_before")
    return rows.withColumn("allowed", F.col("spent_before") < cap)
