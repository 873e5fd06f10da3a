"""Mixing sources to target weights with hash thresholds, in DataFrame operations only.

Each document has a fixed place in [0, 2^48) from a hash of its id. A source whose target is r times its size is taken
floor(r) times in full; of the rest, a source takes the documents below a threshold. The threshold is found without
sorting: tokens are summed by source and hash bucket, the bucket in which the running sum crosses the budget is kept, and
only that bucket is divided further, four levels of 12 bits. Every level reads the slim (id, source, size, place) table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelode.llm.common import cut_lineage, words_of
from codelode.session import maybe_broadcast

BITS, LEVELS = 12, 4
PLACES = BITS * LEVELS
#: Sources are joined by broadcast while their measured rows take no more bytes; above, by shuffle.
BROADCAST_BYTES = 4 << 20


def place(id_col: Column) -> Column:
    """A fixed place in [0, 2^48): the first twelve hex digits of the id's MD5 (a null id as empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, PLACES // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn. A target is ``level * weight`` but at most ``most``
    times the size, with one level for all for which the targets sum to all sizes: what resharing the excess by weight
    ends in. The sources that stop are the first by ratio of their limit to their weight, so running sums give the level.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stopped = F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - stopped) / open_weight
    # A source stops when the level at its turn exceeds its ratio; the level of the first that doesn't stop holds.
    ranked = ranked.withColumn("level", level)
    # From there on the levels only fall, so it is the largest that its own ratio admits.
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return ranked.select("source", "source_size", F.least("limit", F.coalesce(final * F.col("weight"), "limit")).alias("target"))


def _threshold(sized: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """(of, whole, edge): times to take source ``of`` in full, and the place below which it is taken once more."""
    whole = F.floor(F.col("target") / F.col("source_size"))
    state = plan.where("source_size > 0").select(
        F.col("source").alias("of"), whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("within")
    )
    for level in range(LEVELS):
        shift = PLACES - BITS * (level + 1)
        mine = F.col("source").eqNullSafe(F.col("of"))
        if level:
            mine = mine & (F.shiftright("place", shift + BITS) == F.col("prefix"))
        inside = sized.join(maybe_broadcast(state.select("of", "prefix"), small), mine)
        histogram = inside.groupBy("of", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(W.partitionBy("of").orderBy("bucket"))
        cuts = histogram.withColumn("upto", upto).select(F.col("of").alias("source"), "bucket", "n", "upto")
        # The boundary bucket is the first whose end passes the budget; where all fit, the edge lies behind the last.
        crossed = state.join(cuts, mine_of("of", "source"), "left").groupBy("of", "whole", "budget", "prefix").agg(
            F.min_by(F.struct("bucket", "n", "upto"), F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("at"), F.max("bucket").alias("last"), F.coalesce(F.max("upto"), F.lit(0)).alias("all")
        )
        crosses = F.col("at.bucket").isNotNull()
        state = cut_lineage(
            crossed.select(
                "of",
                "whole",
                (F.col("budget") - F.when(crosses, F.col("at.upto") - F.col("at.n")).otherwise(F.col("all"))).alias("budget"),
                F.when(crosses, F.col("at.bucket")).otherwise(F.coalesce(F.col("last") + 1, F.shiftleft("prefix", BITS))).alias("prefix"),
                F.when(crosses, F.col("at.n")).otherwise(F.lit(0)).cast("bigint").alias("within"),
            )
        )
    # The last bucket is one id: it is taken if that comes nearer to the target.
    nearer = (F.col("within") > 0) & (F.col("within") - F.col("budget") < F.col("budget"))
    return state.select("of", "whole", (F.col("prefix") + nearer.cast("bigint")).alias("edge"))


def mine_of(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    id_ = F.col(id_col).cast("bigint")
    return docs.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col)).alias("size"), place(id_).alias("place"))


def plan_mix(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(named, source_size, target, whole, edge) of each source; hinted for broadcast if its measured bytes allow it."""
    plan = cut_lineage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    count, named = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    small = count * 64 + named <= BROADCAST_BYTES
    edges = _threshold(sized, plan, small)
    return maybe_broadcast(plan.withColumnRenamed("source", "named").join(edges, mine_of("named", "of"), "left").drop("of"), small)


def copies(at: Column, most: int) -> Column:
    """How often a document at place ``at`` is taken; a source without words is taken once."""
    found = F.coalesce(F.col("whole") + (at < F.col("edge")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(F.col("source_size") == 0, F.lit(1).cast("bigint")).otherwise(F.least(found, F.lit(most).cast("bigint")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words, ``copies`` is how often the mix takes the document (at most ``most``), ``taken`` is
    ``size * copies``. The words taken of a source miss its target by half a document at most (or half of one id's
    rows, where rows share it), unless that document would pass ``most``. Reruns agree, as places depend on ids alone. Null
    texts and texts without words have size 0 and are taken as their place says; null sources are one source and come
    last; an empty table gives no rows; repeated rows each count; other columns are not looked at.
    """
    sized = cut_lineage(_slim(docs, id_col, text_col, source_col))
    chosen = plan_mix(sized, weights, most)
    return (
        sized.join(chosen, mine_of("source", "named"))
        .withColumn("copies", copies(F.col("place"), most))
        .select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their own columns; texts are not shuffled."""
    chosen = plan_mix(cut_lineage(_slim(docs, id_col, text_col, source_col)), weights, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), place(F.col(id_col).cast("bigint")).alias("place"))
    times = F.array_repeat(F.lit(0), copies(F.col("place"), most).cast("int"))
    return whole.join(chosen, mine_of("source", "named")).select("row", F.explode(times).alias("time")).select("row.*")
