"""Spelling variants: words that differ in one code point, found by a trie of frequency vectors.

A word's vector counts its letters by group. One inserted, deleted or replaced code point adds at most one to one group (a
surplus) and takes at most one from another (a deficit). The trie arranges words by one group's count after the other; a
depth-first search carries all visitors that still have a budget at a node, and the words of a leaf are verified letter by
letter. The trie's upper part is the plan of the shuffle: a node with few enough words is a shard, a larger one is split
by its next group, so a shard is bounded however many words begin alike. Each word lives in one shard and visits those
that its budgets reach; a task keeps one shard and streams its visitors, and hands out a sum for each visitor, no pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm.common import segments
from codelode.session import store

#: Words of a shard; shards at most, beyond which the shards grow (their table goes to every task).
SHARD, MOST_SHARDS = 50_000, 100_000
#: Words of a trie's leaf, visitors that descend together, and distinct words that a task counts before it hands them on.
LEAF, TOGETHER, COUNTED = 128, 16_384, 300_000
#: Letters of a word up to which pairs are verified in rows; longer ones one by one.
ROW = 16
#: Characters of a text that are cut into words at a time.
STRETCH = 1 << 20
#: A letter counts as its own group, the frequent ones first; the letters U+00C0 to U+00FF fall into four more.
LETTERS = b"eainrtosldumchgpbfvykwzxjq"
GROUPS = len(LETTERS) + 4
_GROUP_OF = np.full(256, -1, np.int64)
_GROUP_OF[np.frombuffer(LETTERS, np.uint8)] = np.arange(len(LETTERS))
_GROUP_OF[0xC0:] = len(LETTERS) + np.arange(0x40) % 4
#: All letters are one byte in Latin-1; A-Z becomes lower case, and what is no letter a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def stretches(text: str) -> Iterator[bytes]:
    """A text in folded Latin-1, in pieces that end between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].encode("latin-1", "replace").translate(_FOLD)
        at = end


def words_of(doc_id: int | None, text: str, least: int, every: int | None) -> Counter:
    """Words of at least ``least`` letters with their counts; of every ``every``-th (document, run) one letter is left out."""
    runs: Counter = Counter()
    for piece in stretches(text):
        runs.update([w for w in piece.split(b" ") if len(w) >= least])
    if every is None:
        return runs
    start, found = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        mark = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if mark % every == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def count_words(docs: DataFrame, least_letters: int, least_times: int, every: int | None) -> DataFrame:
    """(word, n) over whole texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update(words_of(doc, text or "", least_letters, every))
                if len(seen) >= COUNTED:
                    yield from _counts(seen)
                    seen.clear()
        yield from _counts(seen)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _counts(seen: Counter) -> Iterator[pa.RecordBatch]:
    words, counts = list(seen), list(seen.values())
    for at in range(0, len(words), 50_000):
        yield pa.record_batch([pa.array([w.decode("latin-1") for w in words[at : at + 50_000]], pa.string()), pa.array(counts[at : at + 50_000], pa.int64())], names=["word", "n"])


def vectors_of(words: list[bytes]) -> np.ndarray:
    """Letters of each word by group. Counts are clipped, which never makes two words differ more."""
    if not words:
        return np.empty((0, GROUPS), np.int8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    group = _GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(owner * GROUPS + group, minlength=len(words) * GROUPS).reshape(-1, GROUPS).clip(0, 120).astype(np.int8)


def unary(vectors: np.ndarray) -> np.ndarray:
    """The vectors once more with a bit for each of the first four letters of a group, in two words: what one has and the
    other lacks is a surplus or deficit."""
    bits = (vectors[:, :, None] > np.arange(4)).reshape(len(vectors), -1)
    padded = np.zeros((len(vectors), 128), bool)
    padded[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(np.packbits(padded, axis=1).view(np.uint64).T)


def descend(trie: np.ndarray, depths: np.ndarray | None, leaf: int, visitors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Depth-first search of a sorted trie: (first row, end, visitors that reach it) of each leaf.

    A node is a range of rows with equal counts so far; it is a leaf when it has at most ``leaf`` rows or ends at its depth.
    """
    none = np.zeros(len(visitors), np.int8)
    stack = [(0, len(trie), 0, np.arange(len(visitors)), none, none)]
    while stack:
        low, high, depth, who, surplus, deficit = stack.pop()
        if high - low <= leaf or depth == (GROUPS if depths is None else depths[low]):
            yield low, high, who
            continue
        column = trie[low:high, depth]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + low + 1
        mine = visitors[who, depth]
        for a, b in zip([low, *cuts.tolist()], [*cuts.tolist(), high], strict=True):
            more = trie[a, depth] - mine
            up, down = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
            use = np.flatnonzero((up <= 1) & (down <= 1))
            if len(use):
                stack.append((a, b, depth + 1, who[use], up[use], down[use]))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # length of the common beginning
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


class Spelled:
    """Words as rows of letters, from their beginning and from their end, so that many pairs are verified at once."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.sizes = words, np.array([len(w) for w in words])
        short = [w if len(w) <= ROW else b"" for w in words]
        self.front, self.back = (np.frombuffer(b"".join(part), np.uint8).reshape(-1, ROW) for part in ([w.ljust(ROW, b"\0") for w in short], [w[::-1].ljust(ROW, b"\0") for w in short]))

    def one_apart(self, mine: np.ndarray, other: Spelled, theirs: np.ndarray) -> np.ndarray:
        """Which pairs one letter tells apart: common beginning and end leave one letter of the longer word."""
        a, b = self.sizes[mine], other.sizes[theirs]
        least = np.minimum(a, b)
        shared = [np.minimum(_run(x[mine] != y[theirs]), least) for x, y in ((self.front, other.front), (self.back, other.back))]
        same = (a == b) & (shared[0] == a)
        found = ~same & (np.abs(a - b) <= 1) & (shared[0] + shared[1] >= np.maximum(a, b) - 1)
        for i in np.flatnonzero(np.maximum(a, b) > ROW).tolist():
            found[i] = one_apart(self.words[mine[i]], other.words[theirs[i]])
        return found


def _run(differs: np.ndarray) -> np.ndarray:
    """Columns before the first one that differs."""
    return np.where(differs.any(1), differs.argmax(1), ROW)


class Shard:
    """The words of one shard as a trie."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        vectors = vectors_of(words)
        order = np.lexsort(vectors.T[::-1])
        self.vectors = vectors[order]
        self.bits = unary(self.vectors)
        self.words, self.counts = [words[i] for i in order], [counts[i] for i in order]
        self.spelled = Spelled(self.words)

    def near(self, words: list[bytes]) -> list[tuple[int, int, bytes] | None]:
        """For each visitor the number of near words, and the one that occurs most with its count."""
        found: list[tuple[int, int, bytes] | None] = [None] * len(words)
        for start in range(0, len(words), TOGETHER):
            together = words[start : start + TOGETHER]
            visitors, spelled = vectors_of(together), Spelled(together)
            bits = unary(visitors)
            for low, high, who in descend(self.vectors, None, LEAF, visitors):
                # A leaf of equal vectors may be larger than LEAF: rows and visitors are compared in bounded blocks.
                for first in range(low, high, LEAF):
                    surplus = deficit = np.uint8(0)
                    for homes, mine in zip(self.bits, bits, strict=True):
                        homes, mine = homes[first : min(high, first + LEAF), None], mine[who]
                        surplus, deficit = surplus + np.bitwise_count(homes & ~mine), deficit + np.bitwise_count(mine & ~homes)
                    h, v = np.nonzero((surplus <= 1) & (deficit <= 1))
                    pairs = np.flatnonzero(self.spelled.one_apart(h + first, spelled, who[v]))
                    for home, visitor in zip((h[pairs] + first).tolist(), (who[v[pairs]] + start).tolist(), strict=True):
                        n, word, best = self.counts[home], self.words[home], found[visitor]
                        if best is None:
                            found[visitor] = (1, n, word)
                        else:
                            better = (n, best[2]) > (best[1], word)  # more often, or as often and smaller
                            found[visitor] = (best[0] + 1, *((n, word) if better else best[1:]))
        return found


def plan_shards(words: DataFrame, cap: int) -> list[tuple[bytes, int]]:
    """Nodes of the trie with at most ``cap`` words, as (counts of the first groups, tiles).

    Level by level, the nodes that are larger are split by their next group. Words that agree in all groups are dealt out
    to as many tiles as needed.
    """
    total = words.count()
    cap = max(cap, ceil(total / MOST_SHARDS) * 16)
    if total <= cap:
        return [(b"", 1)]
    done: list[tuple[bytes, int]] = []
    large = [b""]
    for depth in range(1, GROUPS + 1):
        rows = words
        if depth > 1:
            names = words.sparkSession.createDataFrame([(p,) for p in large], "node binary")
            rows = words.join(F.broadcast(names), F.substring("vector", 1, depth - 1) == F.col("node"), "left_semi")
        nodes = rows.groupBy(F.substring("vector", 1, depth).alias("node")).agg(F.count(F.lit(1)).alias("n")).collect()
        large = [bytes(r["node"]) for r in nodes if r["n"] > cap and depth < GROUPS]
        done += [(bytes(r["node"]), max(1, ceil(r["n"] / cap))) for r in nodes if r["n"] <= cap or depth == GROUPS]
        if not large:
            break
    return sorted(done)


def near_words(words: DataFrame, cap: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words(word, n)`` that have a near word."""

    def with_vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vectors_of([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["word", "n", "vector"])

    rows = store(words.mapInArrow(with_vectors, "word string, n bigint, vector binary"), "spelling-words")
    shards = plan_shards(rows, cap)
    plan = rows.sparkSession.sparkContext.broadcast(shards)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = plan.value
        depths = np.array([len(p) for p, _ in nodes])
        trie = np.frombuffer(b"".join(p.ljust(GROUPS, b"\0") for p, _ in nodes), np.int8).reshape(-1, GROUPS)
        tiles = np.array([t for _, t in nodes])
        for batch in batches:
            names = batch.column("word").to_pylist()
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int8).reshape(-1, GROUPS)
            marks = np.array([zlib.crc32(w.encode()) for w in names], np.int64)
            for low, _high, who in descend(trie, depths, 0, vectors):
                own = (vectors[who, : depths[low]] == trie[low, : depths[low]]).all(1)
                for tile in range(tiles[low]):
                    home = own & (marks[who] % tiles[low] == tile)
                    for at in range(0, len(who), 50_000):
                        part = pa.array(who[at : at + 50_000])
                        size = len(part)
                        role = pa.array(np.where(home[at : at + 50_000], 0, 1).astype(np.int32))
                        yield pa.record_batch([pa.array([low] * size, pa.int32()), pa.array([tile] * size, pa.int32()), role, batch.column("word").take(part), batch.column("n").take(part)], names=["shard", "tile", "role", "word", "n"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, counts, shard = None, [], [], None
        for now, at_home, part in segments(batches, ["shard", "tile"], "role"):
            if now != key:
                if shard is None and homes:
                    yield from _found(Shard(homes, counts), homes)
                key, homes, counts, shard = now, [], [], None
            words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
            if at_home:
                homes += words
                counts += part.column("n").to_pylist()
            elif homes:  # the home words come first; they visit themselves
                if shard is None:
                    shard = Shard(homes, counts)
                    yield from _found(shard, homes)
                yield from _found(shard, words)
        if shard is None and homes:
            yield from _found(Shard(homes, counts), homes)

    dealt = rows.mapInArrow(deal, "shard int, tile int, role int, word string, n bigint").repartition("shard", "tile").sortWithinPartitions("shard", "tile", "role")
    found = dealt.mapInArrow(search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return merged.select("word", "n_near", (-F.col("_best.minus")).alias("best_n"), F.col("_best.best").alias("best"))


def _found(shard: Shard, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    rows = [(w.decode("latin-1"), f[0], f[1], f[2].decode("latin-1")) for w, f in zip(words, shard.near(words), strict=True) if f]
    if rows:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.record_batch(columns, names=["word", "n_near", "best_n", "best"])


def group_variants(docs: DataFrame, least_letters: int = 6, least_times: int = 5, times: int = 5, every: int | None = None, cap: int = SHARD) -> DataFrame:
    """One row per word of ``docs(doc_id, text)``: word, n, form, form_n, root, n_near.

    Words are the runs of letters (A-Z, a-z, U+00C0 to U+00FF) in whole texts, A-Z in lower case, with at least
    ``least_letters`` letters and ``least_times`` occurrences. Two are near if one inserted, deleted or replaced letter
    tells them apart. ``form`` is the near word that occurs most (of equals the smallest), if it occurs ``times`` as often
    as the word; ``root`` follows forms to the last one. With ``every``, of each (document, run) whose CRC-32 of
    ``<doc_id>:<run>`` that number divides one letter is left out first, as misspelling would; without an id nothing stands
    before the colon. Null and empty texts have no words, repeated rows count each, an empty table gives no rows, and other
    columns are not looked at.
    """
    words = store(count_words(docs, least_letters, least_times, every), "spelling-counts")
    joined = words.join(near_words(words, cap), "word", "left")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    rows = store(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "spelling-forms")
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Each step multiplies the occurrences, which bounds the length of a chain; each round doubles what a link spans.
    most = words.agg(F.max("n")).first()[0] or 0
    steps = int(log(max(1, most / least_times)) / log(times) + 1e-9)
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = store(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return rows.join(links, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
