"""Line dedup by a segment-partition edit join.

A line may differ from another in edits that grow with the root of its length, so that its keys grow with its length only:
from ``unit * e ** 2`` characters on a line allows ``e`` edits. The shorter line of a pair is split into ``e + 1`` segments,
half of them counted from its beginning and half from its end. One of them stands in the longer line with at most as many
edits between it and its end of the line as there are segments, so it is found that many places from its own at most. Every
line is indexed by its segments and probes the substrings of itself that can be one; a key is a class of lengths, a segment's
number and a text's hash, and keys meet in one shuffle of (key, line) rows without texts. Keys of one line only go at once.
Of the others, each key's first line is compared with the rest, which clears groups of copies without their pairs; what is
left meets in bounded tiles under bounds on length and letters. Pairs fetch their texts and are verified by a banded
bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import segments, tiled
from codelode.session import store

#: Home lines of a tile; counts above this are not told apart; bytes of texts whose lines are cut out together.
TILE, CLIP, PORTION = 256, 32_000, 1 << 21
#: Rounds after which the order of lines is a hash's.
IN_ORDER = 5
#: Characters by which the allowed edits grow: 1 from 30 on, 2 from 120, 3 from 270, 10 from 3,000.
UNIT = 30
BLANKS = b" \t\n\r\x0b\x0c"
#: A line's number in key rows, below the bit that marks a probe.
NODE, PROBE = (1 << 62) - 1, 1 << 62


def allowed(length: int, unit: int = UNIT) -> int:
    """Edits within which a line of this length is a copy."""
    return isqrt(length // unit)


@lru_cache(maxsize=200_000)
def plan(size: int, unit: int) -> tuple[tuple[int, int, int, bool], ...]:
    """(seed, start, end, is a probe) of the substrings by which a line of this length meets others."""
    own, found = allowed(size, unit), []
    # A line meets lines of its class, and shorter ones of the class below if they can be that close.
    for edits in (own, own - 1):
        if edits < 1 or (edits < own and size - edits >= unit * own * own):
            continue
        width, front = unit * edits * edits // (edits + 1), (edits + 2) // 2
        for i in range(edits + 1):
            right = i >= front
            place = i - front if right else i
            start = size - (place + 1) * width if right else place * width
            seed = (edits << 1 | right) << 24 | place
            for shift in range(-place, place + 1):
                if 0 <= start + shift and start + shift + width <= size:
                    found.append((seed, start + shift, start + shift + width, edits < own or shift != 0))
    return tuple(found)


def line_keys(line: str, unit: int) -> tuple[bytes, list[bool]]:
    """The 8-byte keys of one line, joined, and which of them are probes."""
    mine, digest = plan(len(line), unit), xxhash.xxh64_digest
    if line.isascii():
        raw = line.encode()
        return b"".join([digest(raw[a:b], s) for s, a, b, _ in mine]), [p for *_, p in mine]
    return b"".join([digest(line[a:b].encode(), s) for s, a, b, _ in mine]), [p for *_, p in mine]


def mark_of(line: str) -> bytes:
    """The 128-bit hash that stands for a line."""
    return xxhash.xxh3_128_digest(line.encode())


def node_of(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "little") & NODE


def clean_lines(text: bytes) -> list[str]:
    """Lines without white space at their ends, by which they are compared."""
    return [line.strip(BLANKS).decode("utf-8", "replace") for line in text.split(b"\n")]


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less: a band of the bit-parallel recurrence slides down the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) > len(b):
        a, b = b, a
    start = _shared(a, b)
    a, b = a[start:], b[start:]
    end = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a:
        return len(b) <= most
    # Bit k of the band at column j stands for row j - most + k; rows above the first are copies of the border.
    band = 2 * most + 1
    full, top = (1 << band) - 1, 1 << (band - 1)
    seen: dict[str, int] = {}  # bit i: a[i] is the letter, shifted so that the band can be cut out
    for i, letter in enumerate(a):
        seen[letter] = seen.get(letter, 0) | 1 << (i + most)
    rows = len(a)
    plus, minus = full << most & full, 0  # below the border each row is one more; above it all are equal
    score = most  # of the band's lowest row
    for j in range(len(b)):
        match = seen.get(b[j], 0) >> j & full
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        right_plus = minus | ~(diagonal | plus) & full
        right_minus = diagonal & plus
        # The band moves one row down with the column, so its lowest row is reached along the diagonal.
        score += not diagonal & top
        if score > 3 * most + 1:
            return False
        shifted = diagonal >> 1
        plus = (right_minus | ~(shifted | right_plus) & full) & full
        minus = right_plus & shifted
    # Walk up from the band's lowest row to the last row of a.
    lowest = len(b) - 1 + most
    for row in range(lowest, rows - 1, -1):
        bit = 1 << (row - len(b) + most)
        score += bool(minus & bit) - bool(plus & bit)
    return score <= most


def may_be_within(a: str, b: str, most: int) -> bool:
    """False if more pieces of ``a`` than edits are not in ``b`` near their place, as each edit spoils one at most."""
    width, missing = max(1, len(a) // (2 * most + 2)), 0
    for at in range(0, len(a) - width + 1, width):
        if b.find(a[at : at + width], max(0, at - most), at + most + width) < 0:
            missing += 1
            if missing > most:
                return False
    return True


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _portions(batch: pa.RecordBatch) -> Iterator[list[str]]:
    """Distinct lines of some texts at a time, so that short lines do not fill the memory as objects."""
    found: set[str] = set()
    size = 0
    for text in batch.column("text"):
        raw = text.as_py() or b""
        found.update(clean_lines(raw))
        size += len(raw)
        if size > PORTION:
            yield list(found - {""})
            found, size = set(), 0
    yield list(found - {""})


def shared_keys(slim: DataFrame, unit: int) -> DataFrame:
    """(key, node): keys that one line has in the index and another line has too."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(parts), ">i8").astype(np.int64)
            return pa.record_batch([pa.array(keys), pa.array(np.repeat(np.array(nodes, np.int64), sizes) | np.array(probes, np.int64) << 62)], names=["key", "node"])

        for batch in batches:
            parts, nodes, sizes, probes = [], [], [], []
            for line in (line for some in _portions(batch) for line in some):
                keys, probe = line_keys(line, unit)
                if probe:
                    parts.append(keys)
                    nodes.append(node_of(mark_of(line)))
                    sizes.append(len(probe))
                    probes += probe
                if len(probes) > 100_000:
                    yield rows()
                    parts, nodes, sizes, probes = [], [], [], []
            if probes:
                yield rows()

    def live(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, those of the index first. Of a key without a second line so far only its first line is kept."""
        key, opened, first, sent = None, False, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
            probe, nodes = nodes >> 62 & 1, nodes & NODE
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            fine, leads, told = probe[starts] == 0, nodes[starts].copy(), np.zeros(len(starts), bool)
            if keys[0] == key:
                fine[0], leads[0], told[0] = opened, first, sent
            several = np.logical_or.reduceat(nodes != np.repeat(leads, sizes), starts) | told
            keep = np.repeat(fine & several, sizes)
            found = [keys[keep]], [nodes[keep]]
            if keys[0] == key and fine[0] and several[0] and not told[0]:  # the line that waited
                found[0].append(keys[:1])
                found[1].append(leads[:1])
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in found], names=["key", "node"])
            key, opened, first, sent = keys[-1], bool(fine[-1]), int(leads[-1]), bool(several[-1])

    rows = slim.select("text").mapInArrow(emit, "key bigint, node bigint").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(live, "key bigint, node bigint").distinct()


def _letters(line: str) -> bytes:
    """Counts of letters by their code modulo 32, and the length, as 2-byte numbers."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32) % 32
    return np.append(np.bincount(codes, minlength=32), len(line)).clip(0, CLIP).astype(np.int16).tobytes()


def _texts(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line, text, shape) of the lines with these numbers, once each."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in (some for batch in batches for some in _portions(batch)):
            marks = [mark_of(line) for line in lines]
            yield pa.record_batch([pa.array([node_of(m) for m in marks], pa.int64()), pa.array(marks, pa.binary()), pa.array(lines, pa.string())], names=["node", "line", "text"])

    def shaped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = pa.array([_letters(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([batch.column("line"), batch.column("text"), shapes], names=["line", "text", "shape"])

    found = slim.select("text").mapInArrow(read, "node bigint, line binary, text string").join(nodes, "node", "left_semi")
    return found.select("line", "text").dropDuplicates(["line"]).mapInArrow(shaped, "line binary, text string, shape binary")


def _verified(pairs: DataFrame, texts: DataFrame, unit: int) -> DataFrame:
    """The pairs (a, b: lines) that are within their edits."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_copies(x, y, unit) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    x, y = (texts.select(F.col("line").alias(end), F.col("text").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


def _copies(a: str, b: str, unit: int) -> bool:
    most = allowed(min(len(a), len(b)), unit)
    return may_be_within(a, b, most) and within(a, b, most)


def _meet(unit: int, across: bool):
    """Links (a, b) of a tile, the earlier line first. A line that follows an earlier one of its tile meets no others there.

    ``across`` links lines that stay (``open`` 0) with open ones only, which go.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for now, at_home, rows in segments(batches, ["key", "tile"], "role"):
            if now != key:
                key, homes, shapes = now, [], np.empty((0, 33), np.int16)
            mine = np.frombuffer(b"".join(rows.column("shape").to_pylist()), np.int16).reshape(-1, 33)
            found = []
            for i, row in enumerate(zip(*[rows.column(c).to_pylist() for c in ("line", "text", "open", "at")], strict=True)):
                # Every edit changes the length by one and the counts of letters by two at most; clipped lengths say nothing.
                gap = np.abs(shapes - mine[i])
                most = np.sqrt(np.minimum(shapes[:, 32], mine[i, 32]) // unit).astype(np.int64)
                close = (gap[:, 32] <= most) & (gap[:, :32].sum(1, np.int64) <= 2 * most) | (np.maximum(shapes[:, 32], mine[i, 32]) == CLIP)
                follows = False
                for h in np.flatnonzero(close).tolist():
                    other = homes[h]
                    if other[0] == row[0] or across and other[2] == row[2] or not _copies(other[1], row[1], unit):
                        continue
                    first, second = sorted((other, row), key=lambda x: (x[2], tuple(x[3].values())))
                    found.append((first[0], second[0]))
                    if not across and second is row:
                        follows = True
                        break
                if at_home and not follows:
                    homes.append(row)
                    shapes = np.concatenate([shapes, mine[i : i + 1]])
            yield pa.record_batch([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"])

    return run


def _tile_links(rows: DataFrame, texts: DataFrame, unit: int, across: bool) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = tiled(rows.join(texts, "line"), sizes, ["key"], "line", TILE).sortWithinPartitions("key", "tile", "role", "open", "at")
    return store(dealt.select("key", "tile", "role", "line", "text", "shape", "open", "at").mapInArrow(_meet(unit, across), "a binary, b binary").distinct(), "line-links")


def near_copies(slim: DataFrame, lines: DataFrame, unit: int) -> DataFrame:
    """(line): lines to remove, each within its edits of a line that stays.

    ``lines(line, node, first_doc, place)`` are the distinct lines; earlier ones are preferred to stay. In a round, open lines
    that are near to a line that stays go. Of the others each key's first line is compared with the rest of the key; those near
    to it follow it. All that follow none meet in tiles. What follows no line then stays, what follows a line that stays
    goes, and what follows others only is looked at in the next round. The first open line follows none, so each round
    decides some; after ``IN_ORDER`` rounds a hash gives the order, so that chains end in a number of rounds that grows with
    the logarithm of their length.
    """
    live = store(shared_keys(slim, unit), "line-keys")
    # Stored by itself, its size is known: while it is small the texts of other lines are not shuffled.
    texts = store(_texts(slim, store(live.select("node").distinct(), "line-nodes")), "line-texts")
    at = F.struct("first_doc", "place", "line")
    rows = store(live.join(lines.select("node", "line", at.alias("at")), "node").select("key", "line", F.lit(1).alias("open"), "at"), "line-entries")
    gone, turn = [], 0
    while True:
        turn += 1
        if turn > 1:
            gone.append(_tile_links(rows, texts, unit, across=True).select(F.col("b").alias("line")).distinct())
            rows = rows.join(gone[-1], "line", "left_anti")
        fresh = store(rows.where("open = 1"), "line-open")
        leaders = fresh.groupBy("key").agg(F.min("at").alias("lead"))
        pairs = fresh.join(leaders, "key").where(F.col("line") != F.col("lead.line")).select(F.col("lead.line").alias("a"), F.col("line").alias("b")).distinct()
        near = store(_verified(pairs, texts, unit), "line-links")
        # A key's first line has met all others of the key by now.
        others = fresh.join(leaders, "key").where(F.col("line") != F.col("lead.line")).drop("lead")
        core = store(others.join(near.select(F.col("b").alias("line")).distinct(), "line", "left_anti"), "line-core")
        links = near.unionAll(_tile_links(core, texts, unit, across=False))
        follow = store(links.select(F.col("b").alias("line")).distinct(), "line-follow")
        gone.append(store(links.join(follow.select(F.col("line").alias("a")), "a", "left_anti").select(F.col("b").alias("line")).distinct(), "line-gone"))
        left = store(follow.join(gone[-1], "line", "left_anti"), "line-left")
        if left.isEmpty():
            break
        keys = fresh.join(left, "line", "left_semi").select("key").distinct()
        marked = rows.join(keys, "key", "left_semi").join(gone[-1], "line", "left_anti").join(left.withColumn("_left", F.lit(1)), "line", "left")
        order = F.col("at") if turn < IN_ORDER else F.struct(F.xxhash64("line", F.lit(turn)).alias("first_doc"), F.lit(0).alias("place"), "line")
        rows = store(marked.select("key", "line", F.coalesce("_left", F.lit(0)).alias("open"), order.alias("at")), "line-entries")
    found = gone[0]
    for more in gone[1:]:
        found = found.unionAll(more)
    return found.distinct()


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first place of each line in its document."""

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(places, pa.int32())], names=["doc_id", "line", "place"])

    for batch in batches:
        ids, marks, places = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            seen = {}
            for place, line in enumerate(clean_lines(text.as_py() or b"")):
                if line:
                    seen.setdefault(line, place)
            ids += [doc] * len(seen)
            marks += [mark_of(line) for line in seen]
            places += seen.values()
            if len(ids) > 20_000:
                yield rows()
                ids, marks, places = [], [], []
        yield rows()


def _node() -> Column:
    """``node_of`` as an expression: the first eight bytes of the mark, last one first."""
    byte = lambda i: F.shiftleft(F.conv(F.hex(F.substring("line", i + 1, 1)), 16, 10).cast("bigint"), 8 * i)
    return sum((byte(i) for i in range(1, 8)), byte(0)).bitwiseAND(F.lit(NODE))


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        texts, before, after = [], [], []
        for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
            text, seen, out = text.as_py(), set(gone.as_py() or ()), []
            given = text.split(b"\n") if text is not None else []
            for line in given:
                bare = line.strip(BLANKS).decode("utf-8", "replace")
                mark = mark_of(bare)
                if not bare or mark not in seen:
                    out.append(line)
                    seen.add(mark)
            texts.append(None if text is None else b"\n".join(out).decode("utf-8", "replace"))
            before.append(len(given))
            after.append(len(out))
        columns = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), batch.column("carried")]
        yield pa.record_batch(columns, names=["doc_id", "text", "n_lines", "n_kept", "carried"])


def dedup_lines(docs: DataFrame, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text without lines that copy another line, n_lines, n_kept, and ``carry`` columns.

    Lines end at ``\n`` and are compared without ASCII white space at their ends. Of equal lines the one with the smallest
    (doc_id, place) stays, in that document once. A line also goes, wherever it stands, if it is within ``allowed`` edits
    (by the shorter one's length) of another line that stays, and of two lines as close as that one goes; earlier lines are
    preferred to stay. Blank lines stay. A null text stays null with 0 lines, an empty text has one blank line. Rows that
    share an id are one document to the choice and each keep their lines; lines of rows without an id are not compared with
    those of others. An empty table gives no rows; other columns are not looked at.
    """
    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    slim = whole.select("doc_id", "text").where("doc_id IS NOT NULL")
    spots = slim.mapInArrow(_occurrences, "doc_id bigint, line binary, place int")
    firsts = spots.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    lines = store(firsts.select("line", F.col("n"), F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("place")), "lines")
    removed = near_copies(slim, lines.withColumn("node", _node()), unit).withColumn("removed", F.lit(True))
    dropped = lines.join(removed, "line", "left").where("n > 1 OR removed").select("line", "first_doc", "removed")
    gone = spots.join(dropped, "line").where("removed OR doc_id <> first_doc")
    gone = store(gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone")), "line-gone")
    kind = whole.schema["carried"].dataType.simpleString()
    rebuilt = whole.join(gone, "doc_id", "left").select("doc_id", "text", "gone", "carried").mapInArrow(_rebuild, f"doc_id bigint, text string, n_lines bigint, n_kept bigint, carried {kind}")
    return rebuilt.select("doc_id", "text", "n_lines", "n_kept", *[F.col(f"carried.{c}").alias(c) for c in carry])
