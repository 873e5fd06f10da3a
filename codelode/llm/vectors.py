"""Embedding near-duplicates by short codes that meet in a bounded number of cells.

Unit vectors with a cosine of c or more are at most 2 - 2c apart (squared). The vectors are rotated so that the strongest axes
come first and rounded to 2-byte codes whose error is kept beside them. Nodes fall by hash into groups, and each two groups
meet in one cell: a matrix product over the leading coordinates drops most pairs, the distance of the codes tells of nearly
all others whether they are linked, and only pairs that it can't tell are handed out and verified on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import Links, about, components, segments
from codelode.session import store

#: Vectors of a group from which there are several, visitors compared at once, and about so many rows that the rotation is fitted on.
TILE, VISITORS, FITTED = 2048, 256, 10_000
#: Groups while their codes stay below ``HOME`` bytes each; a vector has a copy for each group.
GROUPS, HOME = 5, 96 << 20
#: Leading coordinates that the first test sees, and home vectors of one matrix product.
LEAD, SLICE = 16, 2048
#: Steps of a code from 0 to 1.
STEPS = 32_767
#: Slack of bounds that are computed in rounded numbers: in doubles, and in floats.
SLACK, LEAD_SLACK = 1e-9, 1e-5


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v / np.abs(v).max(1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in doubles."""
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, width): v is null where the vector can't be compared."""
    v, e = F.transform(F.col(vector_col), lambda x: x.cast("double")), F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(fine, e).alias("v"), F.size(e).alias("width"))


def _marks(v: Column) -> list[Column]:
    """128 bits of a vector; negative zeros are zeros."""
    plain = F.transform(v, lambda x: x + F.lit(0).cast("tinyint"))
    return [F.when(v.isNotNull(), F.xxhash64(F.lit(seed), plain)).alias(name) for seed, name in ((1, "mark"), (2, "more"))]


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Principal axes of a bounded sample, strongest first."""
    sample = about(rows, "mark", FITTED, rows.count()).select("v").limit(4 * FITTED).toArrow()
    x = _unit(_matrix(sample.column(0).combine_chunks())) if sample.num_rows else np.eye(width)
    _, axes = np.linalg.eigh(np.atleast_2d(x.T @ x))
    return axes[:, ::-1]


def _encode(turn: np.ndarray):
    """Codes of rotated unit vectors, each with a bound of its error behind it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = _unit(_matrix(batch.column("v"))) @ turn
            codes = np.rint(turned * STEPS).clip(-STEPS, STEPS).astype(np.int16)
            error = (np.sqrt(((turned - codes / STEPS) ** 2).sum(1)) * (1 + 1e-6) + SLACK).astype(np.float32)
            both = np.concatenate([codes.view(np.uint8), error[:, None].view(np.uint8)], axis=1)
            yield pa.record_batch([*(batch.column(c) for c in ("vec_id", "mark", "more")), pa.array(map(bytes, both), pa.binary())], names=["vec_id", "mark", "more", "code"])

    return run


def _decoded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and bounds of their errors."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return both[:, : 2 * width].copy().view(np.int16), both[:, 2 * width :].copy().view(np.float32)[:, 0].astype(np.float64)


def _cell(low, high, groups: int):
    """Number of the cell where two groups meet."""
    return low * (2 * groups - 1 - low) / 2 + high


def _join(width: int, cosine: float, groups: int):
    far, alone = max(0.0, 2 - 2 * cosine), {int(_cell(g, g, groups)) for g in range(groups)}
    # A code is half a step off in each coordinate at most.
    reach = (np.sqrt(far) + 1.01 * np.sqrt(width) / STEPS + 2 * SLACK) ** 2 + LEAD_SLACK

    def told(home: np.ndarray, error: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair, whether it is linked for sure, and whether it may be."""
        gap = np.sqrt(((home.astype(np.float64) - codes) ** 2).sum(1)) / STEPS
        most, least = gap + error + errors, np.maximum(0, gap - error - errors)
        sure = most**2 <= far - SLACK
        return sure, ~sure & (least**2 <= far + SLACK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, links, home, counts, marks, found = None, Links(), [], None, None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if found is not None and found.any():
                at = np.flatnonzero(found)
                yield _rows(links.ids[at], links.ids[at], found[at])

        for now, at_home, rows in segments(batches, ["cell"], "role"):
            if now != key:
                yield from finish()
                key, links, home = now, Links(), []
                counts, marks, found = (np.zeros(0, np.int64) for _ in range(3))
            n, mark = rows.column("n").to_numpy(), rows.column("mark").to_numpy()
            codes, errors = _decoded(rows.column("code"), width)
            size = len(counts)
            places = links.add(rows.column("rep").to_numpy())
            lead = (codes[:, :LEAD] / np.float32(STEPS)).astype(np.float32)
            square, one = (lead * lead).sum(1)[:, None], np.ones((len(lead), 1), np.float32)
            if at_home:
                counts, marks, found = np.concatenate([counts, n]), np.concatenate([marks, mark]), np.concatenate([found, np.zeros(len(n), np.int64)])
                mine = np.concatenate([lead, square, one], axis=1)
                home += [(size + at, codes[at : at + SLICE], errors[at : at + SLICE], mine[at : at + SLICE]) for at in range(0, len(n), SLICE)]
                if now[0] not in alone:  # these meet each other in the cell of their group
                    continue
            theirs = np.concatenate([-2 * lead, one, square], axis=1)
            pairs, waiting = [], 0
            for start, own, error, left in home:
                for at in range(0, len(n), VISITORS):
                    part = theirs[at : at + VISITORS]
                    close = np.flatnonzero((left @ part.T).ravel() <= reach)
                    a, b = close // len(part), close % len(part) + at
                    if at_home:  # the later of two home vectors sees the earlier
                        earlier = start + a < size + b
                        a, b = a[earlier], b[earlier]
                    for low in range(0, len(a), 1 << 14):
                        x, y = a[low : low + (1 << 14)], b[low : low + (1 << 14)]
                        sure, may = told(own[x], error[x], codes[y], errors[y])
                        if may.any():
                            p, q = start + x[may], y[may]
                            yield _rows(links.ids[p], links.ids[places[q]], counts[p], marks[p], mark[q], n[q])
                        if sure.any():
                            pairs.append((start + x[sure], y[sure]))
                            waiting += len(pairs[-1][0])
                        if waiting > 1 << 18:
                            yield from _linked(pairs, links, places, counts, n, found)
                            pairs, waiting = [], 0
            if pairs:
                yield from _linked(pairs, links, places, counts, n, found)
            if not at_home:
                links.trim(size)
        yield from finish()

    return run


def _linked(pairs: list, links: Links, places: np.ndarray, counts: np.ndarray, n: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count the pairs (home place, visitor), those of home vectors into ``found``, and unite them."""
    x, y = (np.concatenate(ends) for ends in zip(*pairs, strict=True))
    np.add.at(found, x, n[y])
    theirs = np.zeros(len(n), np.int64)
    np.add.at(theirs, y, counts[x])
    seen = np.flatnonzero(theirs)
    ends = links.unite(x, places[y])
    ids = links.ids[places[seen]]
    yield _rows(ids, ids, theirs[seen])
    yield _rows(*ends, np.zeros(len(ends[0]), np.int64))


FOUND = "a bigint, b bigint, n bigint, x bigint, y bigint, m bigint"


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    found = [pa.array(c, pa.int64()) for c in columns]
    found += [pa.nulls(len(found[0]), pa.int64())] * (6 - len(found))
    return pa.record_batch(found, names=["a", "b", "n", "x", "y", "m"])


def _links(nodes: DataFrame, width: int, cosine: float) -> DataFrame:
    """Rows (a, b, n): for a = b, n more links of the vector; else an edge of a forest that links connect.

    Rows that have the other columns are pairs that their codes can't tell, with the numbers n and m and the marks x and y of both.
    """
    count = nodes.count()
    groups = max(min(GROUPS, -(-count // TILE)), -(-count * (2 * width + 4 * LEAD + 24) // HOME), 1)
    group, other = F.pmod(F.xxhash64("mark", F.lit(7)), F.lit(groups)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
    dealt = nodes.select("rep", "n", "mark", "code", group.alias("_group")).select("*", other.alias("_other"))
    low, high = F.least("_group", "_other"), F.greatest("_group", "_other")
    dealt = dealt.select(_cell(low, high, groups).cast("int").alias("cell"), (F.col("_group") != low).cast("int").alias("role"), "rep", "n", "mark", "code")
    dealt = dealt.repartitionById(groups * (groups + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "role")
    return dealt.mapInArrow(_join(width, cosine, groups), FOUND)


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, cosine: float) -> DataFrame:
    """Rows (a, b, n) of the pairs whose vectors are linked."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = np.array([cosines(*(np.array([v], np.float64) for v in both))[0] >= cosine for both in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)], bool)
            a, b, n, m = (batch.column(c).to_numpy()[close] for c in ("a", "b", "n", "m"))
            none = np.zeros(len(a), np.int64)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in ((a, b, a), (a, b, b), (m, n, none))], names=["a", "b", "n"])

    asked = pairs.select(F.col("a").alias("rep"), F.col("x").alias("mark")).unionAll(pairs.select("b", "y")).distinct()
    asked = store(nodes.select("rep", "mark", "more", "width").join(asked, ["rep", "mark"], "left_semi"), "vector-ends")
    texts = rows.select("mark", "more", "width", "v").join(asked, ["mark", "more", "width"]).dropDuplicates(["rep", "mark", "more", "width"])
    texts = store(texts.select("rep", "mark", "v"), "vector-texts")
    one = texts.select(F.col("rep").alias("a"), F.col("mark").alias("x"), F.col("v").alias("u"))
    two = texts.select(F.col("rep").alias("b"), F.col("mark").alias("y"), "v")
    return pairs.join(one, ["a", "x"]).join(two, ["b", "y"]).select("a", "b", "n", "m", "u", "v").mapInArrow(verify, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of ``cosine`` or more, in doubles, are linked. Equal vectors are one node with a count, so copies
    never become pairs. ``component_id`` is the smallest id that links reach, ``kept`` says that it is the row's own.
    Vectors that are null, zero or hold null or non-finite parts link with nothing, nor do vectors of different lengths
    with each other. Repeated rows are kept and count as links of each other; rows without an id count as links of others
    and take their group's component. An empty table gives no rows; other columns are not looked at.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie above 0 and not above 1")
    rows = usable(vectors, id_col, vector_col)
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.col("width")).alias("width"), *_marks(F.col("v")))
    fine, keys = rows.where("v IS NOT NULL"), ["mark", "more", "width"]
    nodes, found = [], []
    for (width,) in fine.select("width").distinct().orderBy("width").collect():  # lengths of vectors, not vectors
        of_width = fine.where(F.col("width") == width)
        coded = of_width.select("vec_id", "mark", "more", "v").mapInArrow(_encode(rotation(of_width, width)), "vec_id bigint, mark bigint, more bigint, code binary")
        coded = coded.groupBy("mark", "more").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"), F.first("code").alias("code"))
        nodes.append(store(coded.withColumn("width", F.lit(width)), "vector-codes"))
        found.append(store(_links(nodes[-1].where("rep IS NOT NULL"), width, cosine), "vector-links"))
    if not nodes:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    nodes, found = (reduce(DataFrame.unionAll, parts) for parts in (nodes, found))
    pairs, links = found.where("m IS NOT NULL"), found.where("m IS NULL").select("a", "b", "n")
    if not pairs.isEmpty():
        links = links.unionAll(store(_verified(pairs, nodes, rows, cosine), "vector-links"))
    more = links.where("a = b").groupBy("a").agg(F.sum("n").alias("more_links"))
    classes = components(links.where("a <> b"))
    linked = nodes.join(more, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    linked = linked.select(*keys, (F.col("n") - 1 + F.coalesce("more_links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    whole = rows.select("vec_id", *keys).join(linked, keys, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
