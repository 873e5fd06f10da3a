"""Merkle manifest of a table as postorder append logs.

The leaves of a source are dealt out to aligned builders of ``3 ** levels`` leaves. A builder takes its leaves in order and
appends every node to its log the moment it is complete, so a log is the postorder of an aligned subtree. Where a node
stands in it follows from the sizes of the subtrees before it (``place``), so the siblings of a proof are read by position,
without links and without a search. The builders' last nodes are the leaves of the next tier, until one is left; the
subroots of the sources are the leaves of one more such tree. No task holds more than one log and one path at a time,
however many rows a source has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.operators.ranking import position
from codelode.session import store

FAN, WIDTH = 3, 32
#: Levels of a builder: 729 leaves and 1,093 digests (35 kB) at most.
LEVELS = 6


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Hex digest of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def combine(digests: bytes) -> bytes:
    """Digest of some digests, which go in as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height_of(nodes: int) -> int:
    """Levels until one of so many nodes is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def place(level: int, index: int, leaves: int, height: int) -> int:
    """Postorder position of a node in a tree with so many leaves, whose last runs may be short.

    Before a node stand all nodes of its level and below up to its last leaf, and above it those that its first leaf ends.
    """
    start, end = index * FAN**level, min((index + 1) * FAN**level, leaves)
    below = sum(-(-end // FAN**k) for k in range(level + 1))
    return below + sum(start // FAN**k for k in range(level + 1, height + 1)) - 1


def append_log(leaves: list[bytes], height: int) -> bytes:
    """All nodes of a subtree in the order in which they are completed."""
    log: list[bytes] = []
    pending: list[list[bytes]] = [[] for _ in range(height + 1)]

    def add(digest: bytes, level: int) -> None:
        log.append(digest)
        if level < height:
            pending[level].append(digest)
            if len(pending[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, pending[level] = pending[level], []
        add(combine(b"".join(run)), level + 1)

    for leaf in leaves:
        add(leaf, 0)
    for level in range(height):
        if pending[level]:
            close(level)
    return b"".join(log)


@lru_cache(maxsize=256)
def _siblings(leaves: int, height: int) -> list[list[tuple[bytes, list[int], int]]]:
    """By level and node: the path's head (siblings to the left and to the right), where they stand in the log, and the parent."""
    out = []
    for level in range(height):
        count, rows = -(-leaves // FAN**level), []
        for index in range(count):
            first = index // FAN * FAN
            run = range(first, min(first + FAN, count))
            head = bytes([(index - first) * FAN + run.stop - 1 - index])
            rows.append((head, [WIDTH * place(level, i, leaves, height) for i in run if i != index], index // FAN))
        out.append(rows)
    return out


def paths(log: bytes, leaves: int, height: int, above: bytes) -> list[bytes]:
    """Path of each leaf of a log: per level a byte with the numbers of left and right siblings, then their digests."""
    found = [above]
    for level in reversed(_siblings(leaves, height)):
        found = [head + b"".join([log[s : s + WIDTH] for s in spots]) + found[parent] for head, spots, parent in level]
    return found


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and its path lead to."""
    at = 0
    while at < len(path):
        left, right = divmod(path[at], FAN)
        middle, end = at + 1 + WIDTH * left, at + 1 + WIDTH * (left + right)
        digest = combine(path[at + 1 : middle] + digest + path[middle:end])
        at = end
    return digest


def siblings_of(path: bytes) -> bytes:
    """Only the digests of a path."""
    parts, at = [], 0
    while at < len(path):
        end = at + 1 + WIDTH * sum(divmod(path[at], FAN))
        parts.append(path[at + 1 : end])
        at = end
    return b"".join(parts)


def _nodes_in_tier(total: int, tier: int, levels: int) -> int:
    return -(-total // FAN ** (levels * tier))


def _block_shape(total: int, tier: int, block: int, levels: int) -> tuple[int, int]:
    """(leaves, height) of a builder."""
    wide, nodes = FAN**levels, _nodes_in_tier(total, tier, levels)
    return min(wide, nodes - block * wide), levels if nodes > wide else height_of(nodes)


def _packed(nodes: DataFrame, carry: list[str], levels: int) -> DataFrame:
    """One row per builder: its leaves in order, and the columns that go with them."""
    block = F.floor(F.col("idx") / F.lit(FAN**levels)).cast("bigint")
    members = F.sort_array(F.collect_list(F.struct("idx", "digest", *carry)))
    rows = nodes.withColumn("block", block).groupBy("tree", "block").agg(members.alias("members"), F.max("total").alias("total"))
    return rows.select("tree", "block", "total", *[F.col(f"members.{c}").alias(c) for c in ("digest", *carry)])


def _build(packed: DataFrame, tier: int, levels: int) -> DataFrame:
    """Runs the builders; each row gets its log and the log's last digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("digest", "total", "block")]
            logs = [append_log(leaves, _block_shape(n, tier, block, levels)[1]) for leaves, n, block in zip(*columns, strict=True)]
            rest = [c for c in batch.schema.names if c != "digest"]
            arrays = [batch.column(c) for c in rest] + [pa.array(logs, pa.binary()), pa.array([log[-WIDTH:] for log in logs], pa.binary())]
            yield pa.record_batch(arrays, names=[*rest, "log", "root"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "digest")
    return packed.mapInArrow(run, f"{kinds}, log binary, root binary")


@dataclass(frozen=True)
class Forest:
    """The logs of some trees, tier by tier, and the root of each tree with the tier that holds it."""

    tiers: list[DataFrame]
    roots: DataFrame
    levels: int

    def log(self) -> DataFrame:
        """(tree, position, level, digest): every node once, at its postorder position in its whole tree."""
        levels, wide = self.levels, FAN**self.levels

        def run(tier: int):
            def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for tree, block, total, log in zip(*[batch.column(c).to_pylist() for c in ("tree", "block", "total", "log")], strict=True):
                        leaves, height = _block_shape(total, tier, block, levels)
                        top, out = height_of(total), []
                        for level in range(tier > 0, height + 1):  # the leaves of an upper tier stand in the logs below
                            for i in range(-(-leaves // FAN**level)):
                                at, above = WIDTH * place(level, i, leaves, height), levels * tier + level
                                out.append((tree, place(above, block * wide // FAN**level + i, total, top), above, log[at : at + WIDTH].hex()))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["tree", "position", "level", "digest"])

            return one

        found = [t.select("tree", "block", "total", "log").mapInArrow(run(i), "tree string, position bigint, level bigint, digest string") for i, t in enumerate(self.tiers)]
        return _union(found)

    def with_paths(self, tops: DataFrame) -> DataFrame:
        """The builders of the lowest tier with the ``path`` above them, given ``tops(tree, tier, path, subroot)`` above the roots."""
        levels = self.levels
        shape = "tree string, block bigint, path binary, subroot binary"

        def spread(tier: int):
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                wide = FAN**levels
                for batch in batches:
                    names = ("tree", "block", "total", "log", "path", "subroot")
                    for tree, block, total, log, path, subroot in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                        found = paths(log, *_block_shape(total, tier, block, levels), path)
                        n = len(found)
                        ids = pa.array([block * wide + i for i in range(n)], pa.int64())
                        yield pa.record_batch([pa.array([tree] * n, pa.string()), ids, pa.array(found, pa.binary()), pa.array([subroot] * n, pa.binary())], names=["tree", "block", "path", "subroot"])

            return run

        above = None
        for tier in reversed(range(len(self.tiers))):
            own = tops.where(F.col("tier") == tier).select("tree", F.lit(0).cast("bigint").alias("block"), "path", "subroot")
            above = own if above is None else own.unionByName(above)
            joined = self.tiers[tier].join(above, ["tree", "block"])
            if tier == 0:
                return joined
            above = joined.select("tree", "block", "total", "log", "path", "subroot").mapInArrow(spread(tier), shape)
        raise AssertionError("a forest has a tier")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def grow(leaves: DataFrame, order: list[str], carry: list[str], levels: int) -> Forest:
    """Trees over ``leaves(tree, digest, ...)``, each in ``order``."""
    wide = FAN**levels
    placed = position(leaves, ["tree"], order, "idx")
    # A row per builder with the size of its tree meets the packed leaves on the same key, so a large tree stays dealt out.
    counts = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    spans = counts.select("tree", F.col("total").alias("_total"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / F.lit(wide)).cast("bigint"))).alias("block"))
    packed = _packed(placed.withColumn("total", F.lit(None).cast("bigint")), carry, levels)
    packed = packed.drop("total").join(spans, ["tree", "block"]).withColumnRenamed("_total", "total")
    tiers = [store(_build(packed, 0, levels), "merkle")]
    most = tiers[0].agg(F.max("total")).first()[0] or 0
    while _nodes_in_tier(most, len(tiers) - 1, levels) > wide:
        tier = len(tiers)
        upper = tiers[-1].where(F.ceil(F.col("total") / F.lit(float(wide**tier))) > 1)
        nodes = upper.select("tree", F.col("block").alias("idx"), F.col("root").alias("digest"), "total")
        tiers.append(store(_build(_packed(nodes, [], levels), tier, levels), "merkle"))
    last = lambda t, tier: t.where(F.ceil(F.col("total") / F.lit(float(wide ** (tier + 1)))) <= 1)
    roots = _union([last(t, i).select("tree", F.lit(i).alias("tier"), "root") for i, t in enumerate(tiers)])
    return Forest(tiers, roots, levels)


def _proofs(batches: Iterable[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    names = ("block", "total", "log", "path", "subroot", "doc_id", "claimed")
    for batch in batches:
        for block, total, log, path, subroot, ids, claims in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            leaves, height = _block_shape(total, 0, block, levels)
            own = [log[s : s + WIDTH] for s in (WIDTH * place(0, i, leaves, height) for i in range(leaves))]
            found = paths(log, leaves, height, path)
            roots = [fold(leaf if claim is None else claim, p).hex() for leaf, claim, p in zip(own, claims, found, strict=True)]
            proofs = [combine(siblings_of(p)).hex() for p in found]
            columns = [pa.array(ids, pa.int64()), [d.hex() for d in own], [subroot.hex()] * leaves, proofs, roots]
            yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


@dataclass(frozen=True)
class Manifest:
    """The trees of all sources, the tree over their subroots, and the root."""

    sources: Forest
    top: Forest
    root: str | None

    def verify(self) -> DataFrame:
        """One row per leaf: its digest, the subroot, the root, the digest of its proof, and the root that its claimed leaf folds to."""
        levels = self.sources.levels
        crown = self.top.roots.select("tree", "tier", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))

        def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = ("block", "total", "log", "path", "name", "at")
                for block, total, log, path, names, tiers in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                    leaves, height = _block_shape(total, 0, block, levels)
                    own = [log[s : s + WIDTH] for s in (WIDTH * place(0, i, leaves, height) for i in range(leaves))]
                    arrays = [pa.array(names, pa.string()), pa.array(tiers, pa.int32()), pa.array(paths(log, leaves, height, path), pa.binary()), pa.array(own, pa.binary())]
                    yield pa.record_batch(arrays, names=["tree", "tier", "path", "subroot"])

        tops = store(self.top.with_paths(crown).select("block", "total", "log", "path", "name", "at").mapInArrow(named, "tree string, tier int, path binary, subroot binary"), "merkle")
        rows = self.sources.with_paths(tops).select("block", "total", "log", "path", "subroot", "doc_id", "claimed")
        found = rows.mapInArrow(lambda b: _proofs(b, levels), "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
        root = F.lit(self.root).cast("string")
        return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``; other columns are not looked at.

    A leaf is the digest of a row's five values, null marked as such. ``claimed``, if given, is the hex digest to be proved
    in the leaf's place (null: the leaf's own). Leaves of a source ascend by doc_id, null first, and then by leaf and claim,
    so rows that share an id have places too and equal rows give equal sets of results. The null source is one of its own,
    before all others and apart from the empty name. An empty table has no root and no rows.
    """
    leaf = leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    claim = F.lit(None).cast("string") if claimed is None else claimed
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(leaf).alias("digest"), F.unhex(claim).alias("claimed"),
    )
    sources = grow(rows, ["doc_id", "digest", "claimed"], ["doc_id", "claimed"], levels)
    subroots = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("tier").alias("at"), F.col("root").alias("digest"))
    top = grow(subroots, ["name"], ["name", "at"], levels)
    root = top.roots.select("root").first()
    return Manifest(sources, top, None if root is None else bytes(root[0]).hex())
