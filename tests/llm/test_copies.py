"""SimHash, line and vector near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import CLASHES, SF, classes, documents, odd_rows
from pyspark.sql import functions as F

from codelode.llm import common, lines, queries, simhash, vectors


def brute_print(text: str) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_prints(rows, found):
    prints = {}
    for doc, text, _ in rows:
        prints.setdefault(brute_print(text), []).append(doc)
    known = list(prints)
    group = classes(list(range(len(known))), lambda a, b: (known[a] ^ known[b]).bit_count() <= 4)
    least = {}
    for i, fp in enumerate(known):
        least.setdefault(group[i], []).extend(d for d in prints[fp] if d is not None)
    want = sorted(((d, f"{fp:016x}", min(least[group[i]], default=None)) for i, fp in enumerate(known) for d in prints[fp]), key=str)
    assert sorted(map(tuple, found), key=str) == want


def test_simhash_odd_rows(spark):
    rows = odd_rows()
    check_prints(rows, simhash.near_duplicates(documents(spark, rows)).collect())
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    check_prints([tuple(r) for r in docs], queries.op1_simhash(spark, SF).collect())


def test_fingerprint_keys_are_not_broadcast(spark):
    """The keys are 64 times their fingerprints, which Spark's estimate of an explode does not show."""
    nodes = spark.createDataFrame([(1 << i,) for i in range(40)] + [(0,)], "fp bigint")
    found = simhash.links(nodes)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_bits", [3, 4, 7])
def test_fingerprint_links(spark, max_bits, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)  # hot keys fall into many tiles
    draw = random.Random(max_bits)
    prints = {draw.getrandbits(64) for _ in range(30)}
    for fp in list(prints)[:8]:
        for _ in range(40):
            fp ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, max_bits + 2)))
            prints.add(fp)
    base = list(prints)[0]
    prints |= {base ^ draw.getrandbits(12) << 20 for _ in range(150)}
    prints = sorted(prints)
    prints = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in prints)
    found = {r[0]: r[1] for r in common.components(simhash.links(spark.createDataFrame([(fp,) for fp in prints], "fp bigint"), max_bits)).collect()}
    want = classes(prints, lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= max_bits)
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_a_chain(spark):
    n = 200
    order = random.Random(3).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    found = {r[0]: r[1] for r in common.components(edges.unionAll(spark.createDataFrame([(None, 3)], edges.schema))).collect()}
    assert found == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(draw, line: str, times: int) -> str:
    for _ in range(times):
        at, kind = draw.randrange(len(line) + 1), draw.randrange(3)
        line = line[:at] + ("" if kind == 0 else draw.choice("abñ ")) + line[at + (kind != 1) :]
    return line


def test_banded_distance():
    draw = random.Random(5)
    for _ in range(4000):
        a = "".join(draw.choice("ab") for _ in range(draw.randint(0, 14)))
        b = edited(draw, a, draw.randint(0, 5)) if a and draw.random() < 0.8 else "".join(draw.choice("ab") for _ in range(draw.randint(0, 14)))
        for most in (1, 2, 3):
            assert lines.within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_lines_within_the_edits_share_a_key():
    draw = random.Random(6)
    cut = lambda pair: [(pair[0][i * 8 : i * 8 + 8], p) for i, p in enumerate(pair[1])]
    met = 0
    for size in [*range(30, 60), 119, 120, 121, 122, 200, 268, 269, 270, 271, 272, 273, 481, 484, 1_100] * 12:
        a = "".join(draw.choice("abñ") for _ in range(size))
        most = lines.allowed(size)
        b = edited(draw, a, draw.randint(0, most))
        if draw.random() < 0.5:  # evenly spread, which leaves the shortest stretches whole
            b = a
            for i in range(most):
                at = min(len(b) - 1, (i + 1) * size // (most + 1) + draw.randint(-1, 1))
                b = b[:at] + draw.choice(["", "x", b[at] + "y"]) + b[at + 1 :]
        short, long = sorted((a, b), key=len)
        if a != b and distance(a, b) <= lines.allowed(len(short)):
            index = {k for k, probe in cut(lines.line_keys(short, lines.UNIT)) if not probe}
            assert index & {k for k, _ in cut(lines.line_keys(long, lines.UNIT))}, (a, b)
            met += 1
    assert met > 300


def bare(line: str) -> str:
    return line.strip(" \t\n\r\x0b\x0c")


def near(a: str, b: str) -> bool:
    """``within`` equals the plain distance in test_banded_distance."""
    return lines.within(a, b, lines.allowed(min(len(a), len(b))))


def check_lines(rows, found):
    """What goes is a copy of what stays, and nothing that stays is a copy of something else that stays."""
    assert sorted((str(d), len((t or "").split("\n")) if t is not None else 0) for d, t, _ in rows) == sorted((str(r["doc_id"]), r["n_lines"]) for r in found)
    given = {}
    for d, t, _ in rows:
        if d is not None:
            given.setdefault(d, set()).update(bare(x) for x in (t or "").split("\n"))
    stays, first = {}, {}
    for r in found:
        if r["doc_id"] is None:
            continue
        kept = [bare(x) for x in (r["text"] or "").split("\n")]
        assert set(kept) <= given[r["doc_id"]] | {""}
        kept = [x for x in kept if x]
        assert len(kept) == len(set(kept))
        for x in kept:
            assert stays.setdefault(x, r["doc_id"]) == r["doc_id"], x
    for d in sorted(given):
        for x in given[d] - {""}:
            first.setdefault(x, d)
    assert all(first[x] == d for x, d in stays.items())
    all_kept = sorted(stays, key=len)
    for x in first.keys() - stays.keys():
        assert any(near(x, y) for y in all_kept), x
    for i, x in enumerate(all_kept):
        for y in all_kept[i + 1 :]:
            if len(y) - len(x) > lines.allowed(len(x)):
                break
            assert not near(x, y), (x, y)
    return stays


def line_rows():
    draw = random.Random(8)
    pool = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(5, 50))) for _ in range(30)]
    rows = []
    for i in range(60):
        own = [edited(draw, draw.choice(pool), draw.choice([0, 0, 1, 2, 4])) + draw.choice(["", " ", "\t"]) for _ in range(draw.randint(1, 6))]
        rows.append((i, "\n".join(own), "s"))
    family = [(300 + i, f"request number {i:05d} of this very long family of lines was served", "s") for i in range(120)]
    return rows + family + [(400, None, "s"), (401, "", "s"), (402, "\n\n x \n\n", None), (None, pool[0] + "\nonly here, without an id to name it", "s"), rows[4]]


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(lines, "TILE", 16)
    monkeypatch.setattr(lines, "IN_ORDER", 2)
    rows = line_rows()
    found = lines.dedup_lines(documents(spark, rows), carry=("source", "kept")).collect()
    stays = check_lines(rows, found)
    assert len(stays) < len({bare(x) for d, t, _ in rows if d is not None for x in (t or "").split("\n")}) - 100
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[400]["n_lines"], by_id[400]["n_kept"], by_id[401]["n_kept"], by_id[402]["n_lines"], by_id[402]["kept"]) == (0, 0, 1, 5, "x")
    unnamed = next(r for r in found if r["doc_id"] is None)
    assert unnamed["n_kept"] == 2
    assert lines.dedup_lines(documents(spark, [])).collect() == []


def test_line_dedup_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_lines(docs, queries.op2_line_dedup(spark, SF).collect())


def test_a_chain_of_edits_goes_only_by_true_copies(spark):
    """Each line two edits from the one before: what goes is near to a line that stays, not to the first of the chain."""
    draw = random.Random(12)
    chain = ["".join(draw.choice("abcdefgh") for _ in range(130))]
    for step in range(15):
        at = 8 * step
        chain.append(chain[-1][:at] + "XY" + chain[-1][at + 2 :])
    rows = [(i, t, "s") for i, t in enumerate(chain)]
    stays = check_lines(rows, lines.dedup_lines(documents(spark, rows)).collect())
    assert chain[0] in stays and 5 <= len(stays) <= 10


def test_edits_grow_with_the_line(spark, monkeypatch):
    monkeypatch.setattr(lines, "TILE", 4)
    draw, rows = random.Random(17), []
    for size in (29, 30, 57, 119, 120, 121, 269, 270, 400, 1_000):
        line = "".join(draw.choice("abcdeñ_") for _ in range(size))
        rows += [edited(draw, line, n) for n in (0, 1, lines.allowed(size), lines.allowed(size), lines.allowed(size) + 2)]
    rows = [(i, t, "s") for i, t in enumerate(rows)]
    stays = check_lines(rows, lines.dedup_lines(documents(spark, rows)).collect())
    assert len(stays) < len(rows) - 15


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Thousands of copies behind a beginning that other lines share are told by their first line, not pair by pair."""
    draw = random.Random(3)
    start = "".join(draw.choice("abcdefgh ") for _ in range(90)).replace(" ", "_")
    line = start + "".join(draw.choice("abcdefgh") for _ in range(90))
    rows = [(i, start + "".join(draw.choice("mnopqrst") for _ in range(90)), "s") for i in range(30)]
    for i in range(700):
        at = draw.randrange(100, 170)
        rows.append((100 + i, line[:at] + draw.choice("uvwxyz") + line[at + 1 :], "s"))
    found = lines.dedup_lines(documents(spark, rows)).collect()
    stays = check_lines(rows, found)
    assert len(stays) == 31


def brute_vectors(rows, cosine=0.95):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, float)) for i, v in rows if fine(v)]

    def near(a, b):
        x, y = good[a][1], good[b][1]
        return len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine

    links = {}
    for a in range(len(good)):
        links.setdefault(a, sum(near(a, b) for b in range(len(good)) if b != a))
    reach = classes([i for i, _ in good], near)
    return sorted([(i, links[k], reach[i], reach[i] == i) for k, (i, _) in enumerate(good)] + [(i, 0, i, True) for i, v in rows if not fine(v)])


@pytest.mark.parametrize("width", [1, 3, 20, 64])
def test_vectors(spark, width, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    monkeypatch.setattr(vectors, "VISITORS", 4)
    draw = np.random.default_rng(width)
    centres = draw.normal(size=(6, width))
    rows = [(i, (centres[i % 6] + draw.normal(size=width) * (0.2 if i % 3 else 0.02)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, [2 * x for x in rows[0][1]]), (301, None), (302, [0.0] * width), (303, [float("nan")] * width), (304, [float("inf")] * width)]
    rows += [(305, [None] * width), (306, []), (307, [1.0] * (width + 1)), (308, [1.0] * (width + 1)), (309, [1e-30] * width), (310, [-0.0] * width)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n string")
    assert sorted(map(tuple, vectors.near_duplicates(table).collect())) == brute_vectors(rows)
    assert vectors.near_duplicates(table.limit(0)).collect() == []


def test_vectors_repeated_and_nameless(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (2, [0.0, 1.0])]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(["(1, 1, 1, True)", "(1, 1, 1, True)", "(None, 0, None, False)", "(None, 0, None, False)", "(2, 0, 2, True)"])


def test_vectors_are_dealt_a_few_times(spark, monkeypatch):
    """What is shuffled stays in proportion to the vectors: a few short rows for each, whatever lies near to it."""
    dealt, cut = spark.sparkContext.accumulator(0), vectors.segments

    def counted(batches, keys, role):
        def seen():
            for batch in batches:
                dealt.add(batch.num_rows)
                yield batch

        return cut(seen(), keys, role)

    monkeypatch.setattr(vectors, "segments", counted)
    monkeypatch.setattr(vectors, "TILE", 16)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(300, 64)))]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == brute_vectors(rows)
    assert 300 <= dealt.value <= 300 * 6


def test_vectors_at_the_bound(spark, monkeypatch):
    """Pairs that codes can't tell are verified on the vectors, also those of repeated vectors."""
    monkeypatch.setattr(vectors, "TILE", 8)
    angle, draw = np.arccos(0.95), random.Random(4)
    turns = [k * angle + draw.choice([-1, 1]) * 10.0 ** -draw.randint(5, 8) for k in range(1, 12) for _ in range(4)]
    rows = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turns)] + [(100 + i, [3.0, 0.0]) for i in range(3)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == brute_vectors(rows)


def test_clashing_names_are_there(spark):
    assert set(CLASHES) <= set(documents(spark, []).columns)
    assert documents(spark, odd_rows()).agg(F.count("*")).first()[0] == len(odd_rows())
