"""A kept inverted index with top-k by threshold (RET-2, JN-4, AGG-7, AGG-8).

Chunks of a run are dealt out to shards by a hash of their id. A posting list is one row per (repository, run, key, token,
shard): sorted chunk ids, delta-coded in blocks of ``BLOCK`` with the last id of each block beside them, so that a reader
looks up some ids without decoding the rest. A term counts in a chunk once, so the largest impact of every block of a list is
its term's weight, and a list needs no other maxima.

A search joins its terms with the lists of their keys and forms rows per (query, term, shard), never per chunk. A task then
takes the lists of one query and shard from the heaviest term down. As soon as the terms that are left can't lift a new chunk
to the k-th best score so far, only chunks already found are looked up in the remaining lists, and those that can't reach that
score any more are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelode.session import is_small, maybe_broadcast

SCOPE = ["repository_id", "ingestion_id"]
#: Chunks of a shard, about; postings of a block.
SHARD, BLOCK = 65_536, 128
#: Chunks whose postings one task of the second step merges at once, about; lists of an output batch; sizes of runs to broadcast.
PART, OUT, SCOPE_ROWS = 4_096, 32_768, 500_000


def encode_lists(ids: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(blocks, directory) of each list ``ids[ends[i]:ends[i + 1]]`` of sorted distinct ids: each block's first id and the steps
    to the next ones, in as many bytes as its largest step needs; the directory holds each block's last id and the end of its
    bytes. All lists are coded at once; steps are unsigned, as two ids may lie more than 2**63 apart."""
    sizes = np.diff(ends)
    per_list = -(-sizes // BLOCK)
    list_of = np.repeat(np.arange(len(sizes)), per_list)
    at = np.arange(len(list_of)) - np.repeat(np.cumsum(per_list) - per_list, per_list)
    begin = ends[:-1][list_of] + at * BLOCK
    count = np.minimum(BLOCK, ends[1:][list_of] - begin)
    steps = np.zeros(len(ids), np.uint64)
    steps[1:] = np.diff(ids).view(np.uint64)
    steps[begin] = 0
    largest = np.maximum.reduceat(steps, begin) if len(begin) else np.empty(0, np.uint64)
    width = np.select([largest < 1 << 8, largest < 1 << 16, largest < 1 << 32], [1, 2, 4], 8)
    stop = np.cumsum(9 + (count - 1) * width)
    start = stop - 9 - (count - 1) * width
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    out[start[:, None] + np.arange(8)] = ids[begin].astype("<i8").view(np.uint8).reshape(-1, 8)
    out[start + 8] = width
    inner = np.ones(len(ids), bool)
    inner[begin] = False
    inner = np.flatnonzero(inner)
    block_of = np.repeat(np.arange(len(begin)), count - 1)
    for w in (1, 2, 4, 8):
        mine = width[block_of] == w
        where, block = inner[mine], block_of[mine]
        place = start[block] + 9 + (where - begin[block] - 1) * w
        out[place[:, None] + np.arange(w)] = steps[where].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    first = np.append(0, np.cumsum(per_list))
    bounds = np.append(0, stop)[first]
    directory = np.empty((len(begin), 2), "<i8")
    directory[:, 0] = ids[begin + count - 1]
    directory[:, 1] = stop - bounds[list_of]
    return _binary(bounds, out), _binary(first * 16, directory)


def _binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(blocks, directory) of one list."""
    blocks, directory = encode_lists(np.asarray(ids, np.int64), np.array([0, len(ids)]))
    return blocks[0].as_py(), directory[0].as_py()


class PostingList:
    """A stored list: decoded whole, or only in the blocks where some ids can be."""

    def __init__(self, blocks: bytes, directory: bytes) -> None:
        self.blocks = blocks
        table = np.frombuffer(directory, "<i8").reshape(-1, 2)
        self.last, self.ends = table[:, 0], table[:, 1]
        self.decoded = 0

    def block(self, i: int) -> np.ndarray:
        raw = self.blocks[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]
        width = raw[8]
        steps = np.frombuffer(raw, f"<i{width}" if width == 8 else f"<u{width}", offset=9).astype(np.int64)
        self.decoded += 1
        return np.cumsum(np.append(np.frombuffer(raw, "<i8", 1), steps))

    def ids(self) -> np.ndarray:
        parts = [self.block(i) for i in range(len(self.ends))]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def contains(self, wanted: np.ndarray) -> np.ndarray:
        """Which of the sorted ids are in the list."""
        found = np.zeros(len(wanted), bool)
        where = np.searchsorted(self.last, wanted)
        for i in np.unique(where[where < len(self.last)]).tolist():
            mine = np.flatnonzero(where == i)
            found[mine] = np.isin(wanted[mine], self.block(i), assume_unique=True)
        return found


def best_of_shard(lists: list[PostingList], units: list[int], k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, sums, ids that were ever formed) of the ``k`` best chunks, by larger sum and then smaller id.

    ``allowed`` are the sorted ids that the request's filters let pass (None: all).
    """
    order = sorted(range(len(lists)), key=lambda i: -units[i])
    rest = np.append(np.cumsum([units[i] for i in order][::-1])[::-1], 0)
    ids, sums, least, formed = np.empty(0, np.int64), np.empty(0, np.int64), -1, 0
    for step, i in enumerate(order):
        if rest[step] >= least:  # a chunk with these terms only may still be among the best
            new = lists[i].ids()
            if allowed is not None:
                new = new[np.isin(new, allowed, assume_unique=True)]
            both = np.union1d(ids, new)
            total = np.zeros(len(both), np.int64)
            total[np.searchsorted(both, ids)] = sums
            total[np.searchsorted(both, new)] += units[i]
            formed += len(both) - len(ids)
            ids, sums = both, total
        else:
            sums = sums + units[i] * lists[i].contains(ids)
        if len(ids) > k:
            least = int(np.partition(sums, len(sums) - k)[len(sums) - k])
            keep = sums + rest[step + 1] >= least
            ids, sums = ids[keep], sums[keep]
    order_of = np.lexsort((ids, -sums))[:k]
    return ids[order_of], sums[order_of], formed


def shard_of(chunk_id: str, n: str) -> Column:
    """Shard of a chunk in a run of ``n`` chunks."""
    return F.pmod(F.xxhash64(F.col(chunk_id).cast("bigint")), F.ceil(F.col(n) / F.lit(SHARD)).cast("bigint")).cast("int")


def _codes(values: pa.Array, ordered: bool) -> tuple[np.ndarray, pa.Array]:
    """(code of each value, value of each code); null is code 0. With ``ordered`` codes follow the values' order."""
    coded = values.dictionary_encode()
    if ordered:
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        known = coded.dictionary.take(order)
    else:
        place, known = np.arange(len(coded.dictionary)), coded.dictionary
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(place, -1)[codes] + 1, known


def _grouped(owner: np.ndarray, keys: pa.Array, tokens: pa.Array, sizes: np.ndarray, ids: np.ndarray, ordered: bool):
    """Lists of the same owner, key and token as one: (owner, keys, tokens, ends, ids), the ids sorted and distinct.

    ``sizes`` are the numbers of ``ids`` of each given list.
    """
    key, known = _codes(keys, ordered)
    token, tokens_known = _codes(tokens, ordered)
    code = (owner * (len(known) + 1) + key) * (len(tokens_known) + 1) + token
    code = np.repeat(code, sizes)
    order = np.lexsort((ids, code))
    code, ids = code[order], ids[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
    code, ids = code[new], ids[new]
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    begin = np.flatnonzero(first)
    rest, token = np.divmod(code[begin], len(tokens_known) + 1)
    owner, key = np.divmod(rest, len(known) + 1)
    pick = lambda values, c: values.take(pa.array(c - 1, mask=c == 0))
    return owner, pick(known, key), pick(tokens_known, token), np.append(begin, len(ids)), ids


def _list(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (scope, shard, part) of a batch of chunks, with its keys, tokens and chunk ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = [batch.column(c) for c in (*SCOPE, "shard")]
        code = np.zeros(batch.num_rows, np.int64)
        for column in group:
            mine, known = _codes(column, False)
            code = np.unique(code * (len(known) + 1) + mine, return_inverse=True)[1]
        row_of, owner = np.unique(code, return_index=True, return_inverse=True)[1:]
        parts = batch.column("parts").to_numpy(zero_copy_only=False).astype(np.int64)[row_of]
        lists, tokens = batch.column("keys"), batch.column("tokens")
        held, with_token = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (lists, tokens))
        # The first keys of a chunk are those with tokens.
        total = np.cumsum(held) - held
        place = np.repeat(total - (np.cumsum(with_token) - with_token), with_token) + np.arange(with_token.sum())
        spread = np.full(int(held.sum()), -1, np.int64)
        spread[place] = np.arange(len(place))
        all_tokens = tokens.flatten().take(pa.array(spread, mask=spread < 0))
        ids = np.repeat(batch.column("chunk_id").to_numpy(zero_copy_only=False).astype(np.int64), held)
        owner, keys, all_tokens, ends, ids = _grouped(np.repeat(owner, held), lists.flatten(), all_tokens, np.ones(len(ids), np.int64), ids, False)
        part = np.zeros(len(keys), np.int64)
        divided = np.flatnonzero(parts[owner] > 1)
        if len(divided):
            distinct = keys.take(pa.array(divided)).dictionary_encode()
            hashed = np.array([crc32(k.encode()) for k in distinct.dictionary.to_pylist()], np.int64)
            part[divided] = hashed[distinct.indices.to_numpy()] % parts[owner[divided]]
        order = np.lexsort((part, owner))
        owner, part, sizes = owner[order], part[order], np.diff(ends)[order]
        ids = ids[np.repeat(ends[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        bounds = np.append(begin, len(owner))
        rows = pa.array(row_of[owner[begin]])
        yield pa.record_batch(
            [*[c.take(rows) for c in group], pa.array(part[begin], pa.int32()), _list(bounds, keys.take(pa.array(order))), _list(bounds, all_tokens.take(pa.array(order))),
             _list(bounds, pa.array(sizes, pa.int32())), _list(np.append(0, np.cumsum(sizes))[bounds], pa.array(ids))],
            names=[*SCOPE, "shard", "part", "keys", "tokens", "sizes", "ids"],
        )


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the fragments, which come sorted by (scope, shard, part)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = [batch.column(c) for c in (*SCOPE, "shard", "part")]
        new = np.zeros(batch.num_rows, bool)
        for column in group:
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        begin = np.append(0, np.flatnonzero(new))
        same = bool(held) and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in (*SCOPE, "shard", "part"))
        if held and not same:
            yield from _lists(pa.Table.from_batches(held))
            held = []
        if len(begin) > 1:  # the last group may go on in the next batch
            yield from _lists(pa.Table.from_batches([*held, batch.slice(0, int(begin[-1]))]))
            held = []
        held.append(batch.slice(int(begin[-1])))
    if held:
        yield from _lists(pa.Table.from_batches(held))


def _lists(fragments: pa.Table) -> Iterator[pa.RecordBatch]:
    """Posting lists of whole groups of fragments, by group and key."""
    rows = fragments.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    group = [rows.column(c) for c in (*SCOPE, "shard", "part")]
    new = np.zeros(rows.num_rows, bool)
    for values in group:
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy()
    owner = np.repeat(np.cumsum(new), column("keys").value_lengths().to_numpy())
    row_of = np.append(0, np.flatnonzero(new))
    sizes = column("sizes").flatten().to_numpy().astype(np.int64)
    owner, keys, tokens, ends, ids = _grouped(owner, column("keys").flatten(), column("tokens").flatten(), sizes, column("ids").flatten().to_numpy(), True)
    for a in range(0, len(owner), OUT):
        b = min(a + OUT, len(owner))
        blocks, directory = encode_lists(ids[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        whose = pa.array(row_of[owner[a:b]])
        scope = [column(c).take(whose) for c in SCOPE]
        shard, n = column("shard").take(whose), pa.array(np.diff(ends[a : b + 1]), pa.int64())
        yield pa.record_batch([*scope, keys[a:b], tokens[a:b], shard, n, blocks, directory], names=[*SCOPE, "match_key", "token", "shard", "n", "blocks", "directory"])


def posting_lists(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored form of ``keyword.build_postings``, by chunk or by posting; the rows of a repository's shard lie together.

    Each task first joins the postings of its own chunks to lists, so that a row of the shuffle is a part of a shard with many
    keys and not one posting. A part has the keys of about ``PART`` chunks, whatever the size of a run.
    """
    sizes = chunks.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_n"))
    sizes = maybe_broadcast(sizes, is_small(sizes, SCOPE_ROWS))
    if "keys" not in postings.columns:
        # A key without a token has an empty list of them.
        tokens = F.when(F.col("token").isNull(), F.array().cast("array<string>")).otherwise(F.array("token"))
        postings = postings.select(*SCOPE, "chunk_id", F.array("match_key").alias("keys"), tokens.alias("tokens"))
    rows = postings.where(F.col("chunk_id").isNotNull()).join(sizes, SCOPE)
    scope = ", ".join(f"{c} {postings.schema[c].dataType.simpleString()}" for c in SCOPE)
    parts = F.ceil(F.least(F.col("_n"), F.lit(SHARD)) / F.lit(PART)).cast("int")
    fragments = rows.select(
        *SCOPE, shard_of("chunk_id", "_n").alias("shard"), parts.alias("parts"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "keys", "tokens"
    ).mapInArrow(_fragments, f"{scope}, shard int, part int, keys array<string>, tokens array<string>, sizes array<int>, ids array<bigint>")
    whole = [*SCOPE, "shard", "part"]
    dealt = fragments.repartition(*whole).sortWithinPartitions(*whole)
    return dealt.mapInArrow(_merged, f"{scope}, match_key string, token string, shard int, n bigint, blocks binary, directory binary")


def pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(scope, keys, shard, n, blocks, directory) of the distinct chunk ids of each list; a list has a shard's chunks at most."""
    lists = rows.groupBy(*SCOPE, *keys, "shard").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("bigint"))).alias("ids"))
    kept = [*SCOPE, *keys, "shard"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            arrays = [batch.column(c) for c in kept] + [pa.array(np.diff(ends), pa.int64()), *encode_lists(flat, ends)]
            yield pa.record_batch(arrays, names=[*kept, "n", "blocks", "directory"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.schema if f.name in kept)
    return lists.select(*kept, "ids").mapInArrow(run, f"{kinds}, n bigint, blocks binary, directory binary")


def write_index(lists: DataFrame, target: str) -> None:
    """Replace the lists of the repositories in ``lists`` (``posting_lists``), as they are dealt out.

    A file's keys are sorted, so a reader of some keys skips the rest.
    """
    (
        lists.sortWithinPartitions("repository_id", "match_key")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(target)
    )


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def merge_lists(matched: DataFrame) -> DataFrame:
    """One list per (scope, term, shard) of ``matched``, whose terms may have met several tokens of a shard."""
    grouped = matched.groupBy(*SCOPE, "term", "shard").agg(
        F.collect_list(F.struct("n", "blocks", "directory")).alias("lists")
    )
    one = F.size("lists") == 1
    single = grouped.where(one).select(*SCOPE, "term", "shard", F.col("lists")[0]["n"].alias("n"), F.col("lists")[0]["blocks"].alias("blocks"), F.col("lists")[0]["directory"].alias("directory"))
    kept = [*SCOPE, "term", "shard"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, coded = [], []
            for lists in batch.column("lists").to_pylist():
                ids = np.unique(np.concatenate([PostingList(x["blocks"], x["directory"]).ids() for x in lists]))
                sizes.append(len(ids))
                coded.append(encode(ids))
            arrays = [batch.column(c) for c in kept] + [pa.array(sizes, pa.int64()), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())]
            yield pa.record_batch(arrays, names=[*kept, "n", "blocks", "directory"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema if f.name in kept)
    several = grouped.where(~one).mapInArrow(run, f"{kinds}, n bigint, blocks binary, directory binary")
    return single.unionByName(several)


def best_chunks(weighted: DataFrame, lists: DataFrame, passing: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, units, total_units, formed): the best ``candidate_k`` of each query and shard.

    ``weighted(query_id, scope, term, units, total_units, candidate_k, filtered)``; ``passing(query_id, shard, allowed)`` has the
    sorted ids that the filters of filtered queries let pass. ``formed`` is the number of chunks that were given a score.
    """
    rows = weighted.join(lists.select(*SCOPE, "term", "shard", "blocks", "directory"), [*SCOPE, "term"])
    grouped = rows.groupBy("query_id", "shard").agg(
        F.collect_list(F.struct("units", "blocks", "directory")).alias("lists"),
        F.first("total_units").alias("total_units"), F.first("candidate_k").alias("candidate_k"), F.first("filtered").alias("filtered"),
    )
    if passing is None:
        grouped = grouped.withColumn("allowed", F.lit(None).cast("array<bigint>"))
    else:
        grouped = grouped.join(passing, ["query_id", "shard"], "left")
        grouped = grouped.withColumn("allowed", F.when(F.col("filtered"), F.coalesce("allowed", F.array().cast("array<bigint>"))))
    query = grouped.schema["query_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lists, k, allowed in zip(*[batch.column(c).to_pylist() for c in ("lists", "candidate_k", "allowed")], strict=True):
                mask = None if allowed is None else np.array(allowed, np.int64)
                found.append(best_of_shard([PostingList(x["blocks"], x["directory"]) for x in lists], [x["units"] for x in lists], max(k, 0), mask))
            sizes = [len(ids) for ids, _, _ in found]
            spread = pa.array(np.repeat(np.arange(len(found)), sizes))
            ids, sums = (np.concatenate([np.empty(0, np.int64), *[f[j] for f in found]]) for j in (0, 1))
            formed = pa.array(np.repeat(np.array([f[2] for f in found], np.int64), sizes))
            yield pa.record_batch([batch.column("query_id").take(spread), pa.array(ids), pa.array(sums), batch.column("total_units").take(spread), formed], names=["query_id", "chunk_id", "units", "total_units", "formed"])

    return grouped.select("query_id", "lists", "total_units", "candidate_k", "allowed").mapInArrow(run, f"query_id {query}, chunk_id bigint, units bigint, total_units bigint, formed bigint")
