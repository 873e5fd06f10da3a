"""Benchmark decontamination by a prefix-filtered set join.

A window of a benchmark item is a set of shingles. As a window counts only when all of it occurs, the join needs one shingle
of each: the rarest over all documents, and a window with a shingle that no document has is out at once. Documents meet
windows on that shingle; its place in the window and the document's length bound where the window can lie, and the words
of the whole window decide. The benchmark is the query set: it goes to the tasks in blocks of bounded size, and all
documents pass each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.session import store

#: Bytes of windows in a block, of a text that are cut into words at a time, and candidates that are verified at a time.
BLOCK, STRETCH, TOGETHER = 8 << 20, 1 << 22, 1 << 16
#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 5
#: A-Z becomes lower case; digits, letters and all beyond ASCII stay, everything else is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield words_of(text[at:end])
        at = end


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(item, words): the windows of each item, its words joined by blanks; a shorter item is one window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text or b"")
                for first in range(0, max(1, len(words) - window + 1) if words else 0, 4_096):
                    last = min(first + 4_096, max(1, len(words) - window + 1))
                    found = pa.array([b" ".join(words[i : i + window]) for i in range(first, last)], pa.binary())
                    yield pa.record_batch([pa.array([item] * len(found), pa.string()), found], names=["item", "words"])

    return items.mapInArrow(run, "item string, words binary").distinct()


class Block:
    """Distinct windows of bounded size as numbers, and their shingles."""

    def __init__(self, windows: list[bytes]) -> None:
        self.number: dict[bytes, int] = {}
        split = [w.split(b" ") for w in windows]
        ids = [self.number.setdefault(word, len(self.number) + 1) for words in split for word in words]
        self.ids = np.array(ids, np.int32)
        self.sizes = np.array([len(words) for words in split], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # A random value a word, from its digest, so that a shingle's key is the same in every block.
        self.values = np.array([0, *(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in self.number)], np.uint64)
        self.shingles = sorted({min(SHINGLE, int(n)) for n in self.sizes})
        places = {s: np.flatnonzero(np.minimum(self.sizes, SHINGLE) == s) for s in self.shingles}
        keys, owners, offsets = [], [], []
        for s, of in places.items():
            mine = self.keys(self.ids, s)
            for offset in range(int(self.sizes[of].max(initial=0)) - s + 1):
                fits = of[self.sizes[of] >= s + offset]
                keys.append(mine[self.starts[fits] + offset])
                owners.append(fits)
                offsets.append(np.full(len(fits), offset))
        self.keys_of, self.owner, self.offset = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, owners, offsets))
        self.known = np.unique(self.keys_of)

    def keys(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Keys of the shingles of so many words at each place; one with a word that no window has gets 0."""
        values = self.values[ids]
        n = max(0, len(ids) - size + 1)
        key, fine = np.full(n, size, np.uint64), np.ones(n, bool)
        for i in range(size):
            part = values[i : i + n]
            key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            fine &= part != 0
        return np.where(fine, key, 0)

    def read(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words (0: in no window)."""
        parts = [np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words)) for words in stretches(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def places(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the document, number of the known shingle there)."""
        for s in self.shingles:
            keys = self.keys(ids, s)
            at = np.searchsorted(self.known, keys).clip(0, max(0, len(self.known) - 1))
            yield (hits := np.flatnonzero(self.known[at] == keys)), at[hits]


class Prefixes:
    """A block's windows by their rarest shingle."""

    def __init__(self, block: Block, counts: np.ndarray) -> None:
        self.block = block
        of = np.searchsorted(block.known, block.keys_of)
        rarity = counts[of]
        order = np.lexsort((block.keys_of, rarity, block.owner))
        first = np.ones(len(order), bool)
        first[1:] = block.owner[order][1:] != block.owner[order][:-1]
        chosen = order[first]
        chosen = chosen[rarity[chosen] > 0]  # a shingle that no document has
        by = np.argsort(of[chosen], kind="stable")
        self.window, self.offset, sorted_of = block.owner[chosen][by], block.offset[chosen][by], of[chosen][by]
        self.begin = np.searchsorted(sorted_of, np.arange(len(block.known)))
        self.count = np.searchsorted(sorted_of, np.arange(len(block.known)), side="right") - self.begin

    def search(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, their places) that occur in a document."""
        block = self.block
        for places, shingle in block.places(ids):
            use = np.flatnonzero(self.count[shingle])
            places, shingle = places[use], shingle[use]
            total = np.cumsum(self.count[shingle])
            done = 0
            while done < len(places):
                last = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + TOGETHER, side="right")))
                n = self.count[shingle[done:last]]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                entry = np.repeat(self.begin[shingle[done:last]], n) + inner
                window = self.window[entry]
                start = np.repeat(places[done:last], n) - self.offset[entry]
                fits = (start >= 0) & (start + block.sizes[window] <= len(ids))  # position and length
                window, start = window[fits], start[fits]
                step = 0
                while len(window):
                    longer = block.sizes[window] > step
                    if not longer.all():
                        yield window[~longer], start[~longer]
                        window, start = window[longer], start[longer]
                    same = ids[start + step] == block.ids[block.starts[window] + step]
                    window, start, step = window[same], start[same], step + 1
                done = last


def _spans(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Disjoint spans that cover the same places, as starts and ends by turns."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1
    return np.stack([starts[fresh], ends[last]], 1).ravel().tolist()


def _covered(spans: list[list[int]]) -> int:
    flat = [pair for one in spans for pair in zip(one[::2], one[1::2], strict=True)]
    total, reach = 0, 0
    for start, end in sorted(flat):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A window is any
    ``window`` consecutive words of an item; an item of fewer words is one window, one without words has none. Words inside
    an occurrence of a window are hit; an item counts when a window of it occurs. ``items_sha256`` is over the ids of these
    items, sorted as strings and joined by commas; items without an id are found but not listed. Null and empty texts have no
    words. Repeated rows and rows that share an id each get a row of their own; an empty benchmark leaves all documents
    clean, and no documents give no rows. Other columns are not looked at.
    """
    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = store(windows_of(items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")), window), "windows")
    total = rows.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 40)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    if n_blocks == 1:
        return _scan(whole, *_windows_in(rows, 1, 0), block=None)
    # Equal texts of one id have equal results, so results of the blocks meet on the id and the text's digest.
    key = [F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.col("doc_id").isNull().alias("_none"), F.sha2("text", 256).alias("_text")]
    named = whole.select("*", *key)
    found = None
    for i in range(n_blocks):
        part = store(_scan(named.where("_text IS NOT NULL"), *_windows_in(rows, n_blocks, i), block=i), "leaks")
        found = part if found is None else found.unionByName(part)
    merged = found.dropDuplicates(["_doc", "_none", "_text", "block"]).groupBy("_doc", "_none", "_text").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "items")]
            out = [(doc, sum(map(len, stretches(text or b""))), _covered(spans or []), len(listed or []), _digest(listed or [])) for doc, text, spans, listed in zip(*columns, strict=True)]
            yield _result(out)

    return named.join(merged, ["_doc", "_none", "_text"], "left").select("doc_id", "text", "spans", "items").mapInArrow(finish, RESULT)


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
    return pa.record_batch([*arrays, pa.array([n > 0 for n in columns[2]], pa.bool_())], names=[part.split()[0] for part in RESULT.split(", ")])


def _windows_in(rows: DataFrame, n_blocks: int, block: int) -> tuple[list[list[str]], list[bytes]]:
    """A block's windows (of bounded bytes) and the items that have each."""
    mine = rows.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == block)
    table = mine.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).orderBy("words").toArrow()
    return table.column("items").to_pylist(), table.column("words").to_pylist()


@lru_cache(maxsize=2)
def _block_of(windows: tuple[bytes, ...]) -> Block:
    return Block(list(windows))


def _scan(whole: DataFrame, names: list[list[str]], windows: list[bytes], block: int | None) -> DataFrame:
    """Two passes: how often each shingle of the windows occurs in all documents, then the search by the rarest ones.

    Without a ``block`` its results are final, else what the block adds to the documents that it hits."""
    context = whole.sparkSession.sparkContext
    shared = context.broadcast(tuple(windows))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _block_of(shared.value)
        seen = np.zeros(len(known.known), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, shingle in known.places(known.read(text or b"")):
                    np.add.at(seen, shingle, 1)
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["shingle", "n"])

    # At most one row per shingle of the block.
    counted = whole.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    found = context.broadcast((counted["shingle"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)))
    listed = context.broadcast(names)

    def hits(prefixes: Prefixes, ids: np.ndarray) -> tuple[list[int], list[str]]:
        parts = [(w, s) for w, s in prefixes.search(ids) if len(w)]
        if not parts:
            return [], []
        window, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        items = {item for w in np.unique(window).tolist() for item in listed.value[w]}
        return _spans(start, start + prefixes.block.sizes[window]), sorted(items)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _block_of(shared.value)
        counts = np.zeros(len(known.known), np.int64)
        counts[found.value[0]] = found.value[1]
        prefixes = Prefixes(known, counts)
        for batch in batches:
            out, use, spans, items = [], [], [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                ids = known.read(text or b"")
                covered, named = hits(prefixes, ids)
                if block is None:
                    out.append((doc, len(ids), _covered([covered]), len(named), _digest(named)))
                elif covered:
                    use.append(i)
                    spans.append(covered)
                    items.append(named)
            if block is None:
                yield _result(out)
            else:
                keys = [batch.column(c).take(pa.array(use, pa.int32())) for c in ("_doc", "_none", "_text")]
                yield pa.record_batch([*keys, pa.array([block] * len(use), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["_doc", "_none", "_text", "block", "spans", "items"])

    if block is None:
        return whole.mapInArrow(search, RESULT)
    return whole.mapInArrow(search, "_doc bigint, _none boolean, _text string, block bigint, spans array<bigint>, items array<string>")
