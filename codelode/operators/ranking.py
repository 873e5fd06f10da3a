"""Latest rows, top-k, budget prefixes and running totals (WIN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.session import cut_lineage


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """WIN-1: the last row of each key by ``order``; combines on the map side."""
    row = F.struct(*df.columns)
    picked = df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def latest_run(runs: DataFrame, completed_only: bool = True) -> DataFrame:
    """WIN-1 for ``runs(id, repository_id, status, created_at, ...)``."""
    rows = runs.where(F.col("status") == "completed") if completed_only else runs
    return latest(rows, "repository_id", ["created_at", "id"])


def top_k(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    most: int | None,
    limit: Column | None = None,
    rank: str = "rank",
) -> DataFrame:
    """WIN-4: first rows of each key, ranked from 1.

    ``most`` is a literal upper bound of ``limit``; a row with a higher limit
    fails the query. Spark cuts every task's rows at the literal before the
    shuffle, so a hot key sends little. ``most`` None takes any limit, for rows
    that their source has already cut to a few times the limit of each key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    if most is None:
        return ranked.where(F.col(rank) <= limit)
    cut = ranked.where(F.col(rank) <= most)
    if limit is None:
        return cut
    fail = F.raise_error(F.lit(f"a limit exceeds the bound of {most} rows")).cast("int")
    return cut.where(F.col(rank) <= F.when(limit > most, fail).otherwise(limit))


def recent_messages(messages: DataFrame, most: int, limit: Column | None = None) -> DataFrame:
    """WIN-2: the last messages of each conversation; ``recency`` 1 is the newest."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return top_k(messages, ["conversation_id"], order, most, limit, rank="recency")


def recent_runs(runs: DataFrame, shown: int = 5) -> DataFrame:
    """WIN-6: newest runs per repository and how many are not shown."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    counts = runs.groupBy("repository_id").agg(
        F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("hidden_count")
    )
    newest = top_k(runs, ["repository_id"], order, shown)
    return newest.join(counts, "repository_id")


def budget_prefix(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    cost: Column,
    base: Column,
    budget: int,
    least_cost: int | None = None,
) -> DataFrame:
    """WIN-3: rows in order while ``base`` plus their costs fits ``budget``.

    If the caller knows that no row costs less than ``least_cost``, at most
    ``budget / least_cost`` rows of a key can fit, and that bound is applied
    first, before the shuffle. Without it rows may cost nothing.
    """
    if least_cost is not None and least_cost > 0:
        ranked = top_k(df, keys, order, max(budget // least_cost, 1), rank="_place")
    else:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = df.withColumn("_place", place)
    running = F.sum(cost).over(
        Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranked.withColumn("tokens_after", (base + running).cast("long"))
        .where(F.col("tokens_after") <= budget)
        .drop("_place")
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same key, excluding the row.

    ``order`` must be total within a key. A key may hold any share of the
    rows: rows are range-partitioned by key and order, summed per partition,
    and only the per-partition sums of a key meet in one place.
    """
    placed = (
        df.withColumn("_value", value)
        .repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn("_part", F.spark_partition_id())
    )
    # Sampling may place the range bounds differently when recomputed, so both
    # uses below have to read the same stored rows.
    placed = cut_lineage(placed)
    spans = placed.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = spans.select(
        *keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    inner = placed.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    joined = inner.join(offsets, [*keys, "_part"])
    total = (F.col("_offset") + F.col("_local")).alias(name)
    return joined.select(*df.columns, total)


def position(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """0-based place of each row within its key, for keys of any size."""
    return running_total(df, keys, order, F.lit(1).cast("long"), name)
