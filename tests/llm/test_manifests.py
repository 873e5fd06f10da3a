"""Merkle manifest, spelling variants and benchmark decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import SF, documents, odd_rows
from pyspark.sql import functions as F

from codelode.llm import leaks, merkle, queries, spelling


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_proof(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        run = level[first : first + 3]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= 3
    return out


def brute_manifest(rows: list[tuple]):
    """rows: (doc_id, source, lang, n_chars, text); (results, nodes of all source trees)."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((hashed(*map(brute_field, row)), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = brute_tree([leaf for leaf, _ in sources[s]])
    top = brute_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (leaf, row) in enumerate(sources[s]):
            proof = brute_proof(trees[s], i) + brute_proof(top, k)
            claim = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                claim = hashed(*map(brute_field, (*row[:4], None if row[4] is None else row[4].replace("\n", ""))))
            for left, right in proof:
                claim = hashed(*left, claim, *right)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], hashed(*[d for a, b in proof for d in a + b]), claim, claim == top[-1][0]))
    return sorted(out, key=str), trees


def tampered():
    lost = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], lost))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_odd_rows(spark, levels):
    rows = odd_rows() + [(300 + i, f"text\n{i}", "hot") for i in range(60)] + [(7, "null source", None), (8, "empty source", "")]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text"))
    want, trees = brute_manifest([(d, s, None, None if t is None else len(t), t) for d, t, s in rows])
    made = merkle.manifest(docs, tampered(), levels)
    assert sorted(map(tuple, made.verify().collect()), key=str) == want
    log = defaultdict(dict)
    for r in made.sources.log().collect():
        log[r["tree"]][r["position"]] = (r["level"], r["digest"])
    for source, tree in trees.items():
        mine = log["" if source is None else f"={source}"]
        assert sorted(mine) == list(range(sum(map(len, tree))))
        want_log = []  # by hand: a node stands behind its last child
        def close(level, i, tree=tree, out=want_log):
            if level:
                for child in range(3 * i, min(3 * i + 3, len(tree[level - 1]))):
                    close(level - 1, child)
            out.append((level, tree[level][i]))
        close(len(tree) - 1, 0)
        assert [mine[i] for i in range(len(mine))] == want_log, source


def test_manifest_of_nothing(spark):
    made = merkle.manifest(documents(spark, []).withColumn("n_chars", F.lit(1)))
    assert made.root is None and made.verify().collect() == []


def test_untampered_rows_are_proved(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(r["verified"] for r in merkle.manifest(docs).verify().collect())


def test_merkle_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = queries.op11_merkle(spark, SF)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_manifest(rows)[0]


def apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, every=199, least=6, times=5):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    seen = {w: n for w, n in seen.items() if len(w) >= least and n >= times}
    by_size = defaultdict(list)
    for w in seen:
        by_size[len(w)].append(w)
    near = {w: [v for size in range(len(w) - 1, len(w) + 2) for v in by_size[size] if apart(w, v)] for w in seen}
    form = {}
    for w, n in seen.items():
        best = min(near[w], key=lambda v: (-seen[v], v), default=None)
        form[w] = best if best is not None and seen[best] >= 5 * n else None
    out = []
    for w, n in seen.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], seen.get(form[w]), root, len(near[w])))
    return sorted(out)


def variant_rows():
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdeéñßÿ×") for _ in range(draw.randint(6, 9))) for _ in range(25)] + ["z" * 40, "ab" * 30]
    rows = []
    for i, word in enumerate(base):
        for step in range(4):  # chains of ever rarer variants
            rows.append((1000 * i + step, " ".join([word] * 5 * 6 ** (3 - step) if step else [word] * 700)))
            at = draw.randrange(len(word))
            word = draw.choice((word[:at] + word[at + 1 :], word[:at] + "x" + word[at + 1 :], word[:at] + "x" + word[at:]))
    rows += [(1, None), (2, ""), (None, "Zzzzzzé " * 6), (3, "naïveĀLänger" * 9), (3, "ÀÉabcdef ÀÉabcdef"), (3, "ÀÉabcdef ÀÉabcdef")]
    return rows


@pytest.mark.parametrize("cap", [7, 20_000])
def test_variants(spark, cap):
    rows = variant_rows()
    docs = documents(spark, [(d, t, "s") for d, t in rows])
    found = spelling.group_variants(docs, every=3, cap=cap)
    want = brute_variants(rows, every=3)
    assert len(want) > 80 and any(r[4] != r[2] and r[2] for r in want)
    assert sorted(map(tuple, found.collect())) == want
    assert spelling.group_variants(documents(spark, []), every=3).collect() == []


def test_one_apart():
    draw = random.Random(2)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(0, 5))) for _ in range(300)] + ["ab" * 9 + c for c in ("", "a", "b", "ab")]
    raw = [w.encode("latin-1") for w in words]
    spelled = spelling.Spelled(raw)
    import numpy as np

    for i, a in enumerate(words):
        want = [apart(a, b) for b in words]
        assert [spelling.one_apart(raw[i], b) for b in raw] == want
        assert spelled.one_apart(np.full(len(words), i), spelled, np.arange(len(words))).tolist() == want


def test_variants_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_spelling(spark, SF)
    assert found.columns == ["word", "n", "form", "form_n", "root", "n_near"]
    assert sorted(map(tuple, found.collect())) == brute_variants(rows)


def brute_leaks(docs, items, window=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    windows = defaultdict(set)
    for item, text in items:
        found = words(text)
        for i in range(max(1, len(found) - window + 1) if found else 0):
            windows[tuple(found[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        mine, hit, listed = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(mine) - size + 1):
                if (key := tuple(mine[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    listed |= windows[key]
        listed = sorted(str(i) for i in listed if i is not None)
        out.append((doc, len(mine), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_rows():
    draw = random.Random(9)
    word = lambda: draw.choice(("a", "b", "Ab", "é", "x9", "zß"))
    items = [(i, " ".join(word() for _ in range(draw.randint(0, 30)))) for i in range(40)]
    items += [(50, "a"), (51, "b, Ab! É"), (52, None), (53, "..."), (None, "é é é é é é"), (54, items[3][1]), (54, items[4][1]), (55, "never seen words here at all")]
    docs = [(d, t) for d, t, _ in odd_rows()]
    for i in range(80):
        text = " ".join(word() for _ in range(draw.randint(0, 60)))
        for _ in range(draw.randint(0, 3)):
            text += draw.choice("-_\n") + (draw.choice(items)[1] or "")
        docs.append((i, text))
    return docs + docs[-3:] + [(500, "\n".join(t or "" for _, t in docs) * 3)], items


@pytest.mark.parametrize("block", [1 << 23, 4_000])
def test_leaks(spark, block, monkeypatch):
    monkeypatch.setattr(leaks, "TOGETHER", 50)
    docs, items = leak_rows()
    table = documents(spark, [(d, t, "s") for d, t in docs])
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, words string, doc_id string")
    assert sorted(map(tuple, leaks.decontaminate(table, bench, block_bytes=block).collect()), key=str) == brute_leaks(docs, items)
    assert sorted(map(tuple, leaks.decontaminate(table, bench.limit(0), block_bytes=block).collect()), key=str) == brute_leaks(docs, [])
    assert leaks.decontaminate(table.limit(0), bench, block_bytes=block).collect() == []


def test_leaks_query(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = queries.op13_decontamination(spark, SF)
    assert found.columns == leaks.RESULT.replace(" bigint", "").replace(" string", "").replace(" boolean", "").split(", ")
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == brute_leaks(docs, items) and any(r[5] for r in got)
