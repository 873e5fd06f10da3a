"""Shards of near-equal size by longest-processing-time scheduling; equal texts stay together.

Groups that are large against a shard are scheduled one by one, largest first, each to the least-loaded shard. The number
of such groups is bounded by their share of all bytes. All smaller groups are first poured by a hash of their text into a
fixed number of bundles, and the bundles are scheduled with them. So the heap sees a bounded list, whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window as W, functions as F

from codelode.llm.common import cut_lineage

#: Bundles a shard; a group of more than the mean bundle is scheduled by itself, at most as many as there are bundles.
BUNDLES = 128
#: Rows of a slot block: positions are counted inside a block and blocks by their counts.
BLOCK = 20_000


def schedule(loads: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest first (ties by name) to the least-loaded shard (ties to the lowest)."""
    heap = [(0, i) for i in range(shards)]
    placed = {}
    for size, name in sorted(loads, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shard sizes (text bytes plus ``overhead`` a row) are near equal: within one bundle, about 1 / 128
    of a shard, unless one group of equal texts alone is larger than a shard. ``slot`` numbers the rows of a shard
    without gaps; ``grown_shard`` is null under this law. A null text counts as empty. Repeated rows keep a slot each; rows
    of one id are ordered at will. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        )
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(groups.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(shards * BUNDLES))))
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    lone = F.col("bytes") > F.lit((total or 0) / (shards * BUNDLES))
    units = groups.select(F.when(lone, F.hex("digest")).otherwise(F.col("bundle").cast("string")).alias("unit"), "bytes")
    loads = [(r[1], r[0]) for r in units.groupBy("unit").agg(F.sum("bytes")).collect()]  # at most 2 * shards * BUNDLES
    placed = spark.createDataFrame(list(schedule(loads, shards).items()), "unit string, shard int")
    large = groups.where(lone).select(F.col("digest").alias("whole"))
    blocks = max(1, (count or 0) // BLOCK)
    named = (
        rows.join(F.broadcast(large), F.col("digest") == F.col("whole"), "left")  # at most shards * BUNDLES digests
        .withColumn("unit", F.when(F.col("whole").isNotNull(), F.hex("digest")).otherwise(F.pmod(F.xxhash64("digest"), F.lit(shards * BUNDLES)).cast("string")))
        .join(F.broadcast(placed), "unit")  # as bounded as the list
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
        .select("doc_id", "size", "text_crc32", "shard", "block")
    )
    before = named.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return (
        named.withColumn("inside", inside)
        .join(before, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
