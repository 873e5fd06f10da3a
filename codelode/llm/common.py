"""Helpers of the operators: key groups dealt out in bounded tiles, and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.session import configure, cut_lineage

__all__ = ["Links", "about", "components", "configure", "cut_lineage", "segments", "tiled"]


def tiled(rows: DataFrame, sizes: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """Deal the rows of each key out to tiles of about ``cap`` rows, so that every pair of rows of a key meets once.

    ``sizes`` has the keys to keep and the number ``n`` of their rows. A row is at home (``role`` 0) in one tile and
    visits (``role`` 1) the lower tiles of its key. The result is partitioned by key and tile and sorted with the home rows first, so a task keeps one home
    tile and reads its visitors as a stream, however many rows a key has. Equal members get equal tiles.
    """
    home = F.pmod(F.xxhash64(member), F.ceil(F.col("_n") / F.lit(cap)))
    return (
        rows.join(sizes.select(*keys, F.col("n").alias("_n")), keys)
        .withColumn("_home", home)
        .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), "_home")))
        .withColumn("role", (F.col("tile") != F.col("_home")).cast("int"))
        .drop("_n", "_home")
        .repartition(*keys, "tile")
        .sortWithinPartitions(*keys, "tile", "role")
    )


def segments(batches: Iterable[pa.RecordBatch], keys: list[str], role: str) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Cut sorted batches into stretches of one key and one role: (key, at home, rows)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in [*keys, role]]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(c[start] for c in columns[:-1]), not columns[-1][start], batch.slice(start, stop - start)


class Links:
    """Union-find over the members of one tile; hands out a spanning forest instead of all pairs."""

    def __init__(self) -> None:
        self.ids = np.empty(0, np.int64)
        self.root = np.empty(0, np.int64)

    def add(self, ids: np.ndarray) -> np.ndarray:
        """Places of the new members."""
        at = np.arange(len(self.ids), len(self.ids) + len(ids))
        self.ids = np.concatenate([self.ids, ids])
        self.root = np.concatenate([self.root, at])
        return at

    def trim(self, size: int) -> None:
        """Forget the members from ``size`` on; roots are the smallest places, so none is lost."""
        self.ids, self.root = self.ids[:size], self.root[:size]

    def unite(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Link places ``a`` with places ``b``; the edges (as ids) of a forest that adds what was not yet connected."""
        before = self.root.copy()
        while True:
            low, high = self.root[a], self.root[b]
            differ = low != high
            if not differ.any():
                break
            a, b, low, high = a[differ], b[differ], low[differ], high[differ]
            np.minimum.at(self.root, np.maximum(low, high), np.minimum(low, high))
            while (step := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = step
        moved = np.flatnonzero((before != self.root) & (before == np.arange(len(before))))
        return self.ids[moved], self.ids[self.root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b: long) reaches, as (node, component).

    Alternates the two star operations until the edges are a forest of stars; each round is a few grouped minima and
    joins, cut from its lineage by a reliable checkpoint. Null ends and loops are ignored.
    """
    now = cut_lineage(_down(edges.select("a", "b")))
    mark = _mark(now)
    while mark[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        mark, before = _mark(now), mark
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def about(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows, by a hash of ``key``: no sort, and no list of each partition to the driver."""
    share = min(1.0, most / max(1, total))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def words_of(text: Column) -> Column:
    """Number of words, which ASCII white space separates (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")
