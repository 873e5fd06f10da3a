"""SimHash near-duplicates: 64-bit fingerprints, joined within a few differing bits by chains of segments.

The 64 bits form a ring of ``max_bits + 1`` segments. If two fingerprints differ in at most ``max_bits`` bits, some
segment starts a chain in which the first l segments together differ in at most ``l * max_bits / (max_bits + 1)`` bits,
for every l. So the first segment of the chain is equal and the second differs in one bit at most: that is the key of an
equi-join (each bit of the second segment masked once). Longer prefixes of the chain are tested before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import Links, components, cut_lineage, segments, tiled

#: Home rows of a tile: its pair matrix is made in slices of 4 MB.
TILE = 4096
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of one text as a signed 64-bit number; no word gives 0."""
    words = text.lower().split()  # bytes: folds A-Z only and splits at ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        starts, ends = [0], [None]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts, ends = (stops - sizes)[: len(words) - width + 1].tolist(), stops[width - 1 :].tolist()
    line, digest = b" ".join(words), xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)]), np.uint8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 * COUNTED):
        votes += np.unpackbits(hashes[at : at + 8 * COUNTED]).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, from the whole text. A null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text or b"", width) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


def _widths(max_bits: int) -> list[int]:
    n = max_bits + 1
    return [64 // n + (i < 64 % n) for i in range(n)]


#: Bits of the two segments of a key; the slot stands above them.
KEY_BITS = 56


def _chain_keys(fp: Column, max_bits: int) -> Column:
    """All keys of a fingerprint: first segment of a chain, and the second with one bit masked, under a slot of its own."""
    widths, keys, slot = _widths(max_bits), [], 0
    offsets = [sum(widths[:i]) for i in range(len(widths))]
    part = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for o, w in zip(offsets, widths, strict=True)]
    for i in range(len(widths)):
        j = (i + 1) % len(widths)
        for bit in range(widths[j]):
            rest = part[j].bitwiseAND(F.lit(((1 << widths[j]) - 1) & ~(1 << bit)).cast("bigint"))
            keys.append(F.shiftleft(part[i], widths[j]).bitwiseOR(rest).bitwiseOR(F.lit(slot << KEY_BITS).cast("bigint")))
            slot += 1
    return F.array(*keys)


def _chains(max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each slot of a key: masks of the growing chain and their budgets."""
    widths = _widths(max_bits)
    masks = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    n, out = len(widths), []
    for i in range(n):
        ring = [masks[(i + k) % n] for k in range(n)]
        grown = np.array([sum(ring[: k + 1]) for k in range(n)], np.uint64)
        budget = np.array([(k + 1) * max_bits // n for k in range(n)])
        out += [(grown, budget)] * widths[(i + 1) % n]
    return out


def _chain_holds(differ: Column, max_bits: int) -> Column:
    """Whether the chain that starts at the segment of ``slot`` stays within its budgets."""
    found, chains, widths = F.lit(False), _chains(max_bits), _widths(max_bits)
    at, slot = F.shiftright("key", KEY_BITS), 0
    for i in range(len(widths)):
        end = slot + widths[(i + 1) % len(widths)]
        within = F.lit(True)
        for mask, most in zip(*chains[slot], strict=True):
            signed = int(mask.astype(np.int64))
            within = within & (F.bit_count(differ.bitwiseAND(F.lit(signed).cast("bigint"))) <= F.lit(int(most)))
        found = found | (at.between(slot, end - 1) & within)
        slot = end
    return found


def _linked(home: np.ndarray, visitors: np.ndarray, chain: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (home, visitor) whose chain stays within its budget at every length; the last length is the full distance."""
    differ = home[:, None] ^ visitors[None, :]
    grown, budget = chain
    a, b = np.nonzero(np.bitwise_count(differ & grown[1]) <= budget[1])
    left = differ[a, b]
    for mask, most in zip(grown[2:], budget[2:], strict=True):
        keep = np.bitwise_count(left & mask) <= most
        a, b, left = a[keep], b[keep], left[keep]
    return a, b


def _find_links(max_bits: int):
    chains = _chains(max_bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, links, homes = None, Links(), np.empty(0, np.uint64)
        for now, at_home, rows in segments(batches, ["key", "tile"], "role"):
            if now != key:
                key, links, homes = now, Links(), np.empty(0, np.uint64)
            fps = rows.column("fp").to_numpy().view(np.uint64)
            size = len(homes)
            places = links.add(rows.column("fp").to_numpy())
            if at_home:
                homes = np.concatenate([homes, fps])
            step = max(1, (1 << 19) // max(1, len(homes)))
            for start in range(0, len(fps), step):
                a, b = _linked(homes, fps[start : start + step], chains[key[0] >> KEY_BITS])
                ends = links.unite(a, places[start : start + step][b])
                if len(ends[0]):
                    yield pa.record_batch([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])
            if not at_home:
                links.trim(size)

    return run


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``nodes`` (fp) that connect what links connect."""
    if not 2 < max_bits < 32:
        raise ValueError("max_bits must lie between 3 and 31")
    # Fingerprints are few bytes but become many keys, so they keep the full number of partitions. Dealt by a hash of
    # the fingerprint: by the fingerprint itself, the exchange would be merged with that of a grouping before it.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.repartition(parts, F.xxhash64("fp")).select("fp", F.explode(_chain_keys(F.col("fp"), max_bits)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    pairs = sizes.where("n = 2").where(_chain_holds(F.col("a").bitwiseXOR(F.col("b")), max_bits)).select("a", "b")
    # Spark sizes an explode by its input, and would copy all keys of a few MB of fingerprints to every task.
    more = tiled(rows.hint("merge"), sizes.where("n > 2"), ["key"], "fp", TILE)
    return pairs.unionAll(more.mapInArrow(_find_links(max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most ``max_bits`` bits are linked; the component is the smallest id reachable, the
    document's own included. Documents with one fingerprint are one node, so copies never become pairs. Null and empty
    texts have fingerprint zero and are linked like any other; rows without an id link too and take their group's
    component, null if no row of the group has one. An empty
    table gives no rows; repeated rows are kept; other columns are not looked at.
    """
    prints = cut_lineage(fingerprints(docs, width, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = nodes.join(components(links(nodes.select("fp"), max_bits)), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    least = found.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes = found.select("fp", "group").join(least, "group").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
