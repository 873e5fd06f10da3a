import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode import fixed
from codelode.functions import text as tx
from codelode.operators import approximate, fusion, inverted, keyword, overview, semantic, vector_lists
from codelode.plans.search import answer_requests, not_indexed, search, with_defaults

CHUNK = (
    "chunk_id long, repository_id int, ingestion_id int, file_path string, language string, chunk_type string, name string, "
    "start_line int, end_line int, chunk_text string, embedding array<float>"
)
QUERY = (
    "query_id long, repository_id int, ingestion_id int, query string, query_vector array<float>, candidate_k int, top_k int, "
    "min_score double, mode string, file_extensions array<string>, file_paths array<string>"
)


def chunk(i, path, text, name=None, vector=None, repo=1, run=1, start=1):
    return (i, repo, run, path, "Python", None, name, start, start + 3, text, vector)


def ask(i, text, vector=None, k=10, repo=1, run=1, mode="hybrid", low=None, exts=None, paths=None):
    return (i, repo, run, text, vector, 2 * k, k, low, mode, exts, paths)


VOCABULARY = ["image", "images", "encoder", "retrieval", "class", "token", "verify_token", "a/b.py", "naïve", "été", "x", "log", "logger", "re-use", "v1.2", "ñ", "(the end.)", "end."]


def corpus(seed, size=120):
    draw = random.Random(seed)
    rows = []
    for i in range(size):
        text = " ".join(draw.choice(VOCABULARY) + draw.choice(["", ".", ",", "!", "()", "_z"]) for _ in range(draw.randint(1, 9)))
        vector = None if i % 7 == 0 else [draw.uniform(-1, 1) for _ in range(8)]
        path = draw.choice(["src/", "docs/", "lib/x_", ""]) + f"f{i}" + draw.choice([".py", ".md", ".ts"])
        # Repository 1 holds most chunks.
        rows.append(chunk(i, path, text, draw.choice([None, "", "Token", "log"]), vector, repo=1 if draw.random() < 0.7 else 2))
    queries = []
    for i in range(24):
        words = " ".join(draw.choice(VOCABULARY + ["zebra", "the", "how", "(see the end.)."]) for _ in range(draw.randint(1, 5)))
        exts = draw.choice([None, None, [], ["py"], [".md", ".ts"]])
        paths = draw.choice([None, None, ["src/"], ["lib/x%", "do_s/"]])
        queries.append(ask(i, draw.choice([words, "log", "TOKEN"]), [draw.uniform(-1, 1) for _ in range(8)], draw.randint(1, 6),
                           repo=draw.choice([1, 2]), exts=exts, paths=paths))
    return rows, queries


def allowed(path, exts, paths):
    like = lambda p: re.fullmatch("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in p) + ".*", path)
    return (not exts or any(path.endswith("." + e.lstrip(".")) for e in exts)) and (not paths or any(like(p) for p in paths))


def words_of(blob):
    return {w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.findall("[a-z0-9]+", blob)}


def matches(term, blob):
    if re.fullmatch("[a-z0-9]+", term):
        return (term[:-1] if len(term) > 3 and term.endswith("s") else term) in words_of(blob)
    return term in blob


def keyword_by_hand(chunks, query, terms):
    """Scores of one query, chunk after chunk."""
    mine = [c for c in chunks if c[1] == query[1]]
    blob = {c[0]: f"{c[6] or ''} {c[3]} {c[9]}".lower() for c in mine}
    df = {t: sum(matches(t, b) for b in blob.values()) for t in terms}
    weight = {t: math.log(1 + (len(mine) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
    scored = []
    for c in mine:
        if not allowed(c[3], query[9], query[10]):
            continue
        hit = [t for t in terms if matches(t, blob[c[0]])]
        if c[6] and c[6].lower() == query[3].strip().lower():
            scored.append((c[0], 1.0))
        elif hit:
            scored.append((c[0], sum(weight[t] for t in hit) / sum(weight.values())))
    return sorted(scored, key=lambda s: (-round(s[1], 9), s[0]))[: query[5]]


@pytest.mark.parametrize("seed, small", [(1, True), (2, False), (3, True)])
def test_keyword_search_equals_brute_force(spark, seed, small):
    rows, queries = corpus(seed)
    chunks, asked = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(queries, QUERY)
    terms = {r.query_id: sorted({t.lower() for t in r.t}) for r in asked.select("query_id", tx.lexical_terms(F.col("query")).alias("t")).collect()}
    got = {}
    for r in keyword.keyword_search(asked, chunks, small=small).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, pytest.approx(r.lex_score, abs=1e-9)))
    for q in queries:
        assert keyword_by_hand(rows, q, terms[q[0]]) == got.get(q[0], []), q


def semantic_by_hand(chunks, query):
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    scored = [
        (c[0], float(np.clip(unit(query[4]) @ unit(c[10]), 0, 1)))
        for c in chunks
        if c[1] == query[1] and c[10] is not None and allowed(c[3], query[9], query[10])
    ]
    return sorted(scored, key=lambda s: (-round(s[1], 12), s[0]))[: query[5]]


@pytest.mark.parametrize("limit", [2000, 0])
def test_semantic_search_equals_brute_force_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(semantic, "CHUNK_CELL_ROWS", 10)
    monkeypatch.setattr(semantic, "QUERY_CELL_ROWS", 4)
    rows, queries = corpus(5)
    found = semantic.semantic_search(spark.createDataFrame(queries, QUERY), spark.createDataFrame(rows, CHUNK), limit)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, pytest.approx(r.sem_score, abs=1e-9)))
    for q in queries:
        assert semantic_by_hand(rows, q) == got.get(q[0], [])


def test_vectors_of_mixed_width_are_an_error(spark):
    rows = [chunk(1, "a", "x", None, [1.0, 0.0]), chunk(2, "b", "x", None, [1.0])]
    with pytest.raises(Exception, match="width"):
        semantic.semantic_search(
            spark.createDataFrame([ask(1, "q", [1.0, 0.0])], QUERY), spark.createDataFrame(rows, CHUNK).coalesce(1)
        ).collect()


def fuse_one(spark, query, candidates, chunks, k=10, low=None):
    """``candidates``: (chunk_id, sem, lex)."""
    merged = spark.createDataFrame(
        [(1, c, s, x, (0, i)) for i, (c, s, x) in enumerate(candidates)],
        "query_id long, chunk_id long, sem_score double, lex_score double, first_seen struct<source:int,source_rank:int>",
    )
    asked = spark.createDataFrame([ask(1, query, k=k, low=low)], QUERY)
    rows = fusion.fuse(merged, asked, spark.createDataFrame(chunks, CHUNK)).orderBy("rank").collect()
    return [(r.chunk_id, r.score, r.retrieval_sources) for r in rows]


def test_fusion_worked_examples(spark):
    code = chunk(1, "x/y.py", "pass", "verify")
    assert fuse_one(spark, "Verify ", [(1, 0.8, 0.5)], [code]) == [(1, 0.91, ["semantic", "keyword"])]
    auth = chunk(1, "app/auth/login.py", "pass")
    assert fuse_one(spark, "auth flow", [(1, 0.5, 0.0)], [auth]) == [(1, 0.45, ["semantic"])]
    assert fuse_one(spark, "auth flow", [(1, 0.07, 0.0)], [auth]) == [(1, 0.049, ["semantic"])]
    two = [chunk(1, "m.py", "pass"), chunk(2, "n.py", "pass")]
    assert [(c, s) for c, s, _ in fuse_one(spark, "zzz", [(1, 0.9, 0.0), (2, 0.4, 0.8)], two)] == [(1, 0.63), (2, 0.52)]


def test_fusion_keeps_list_order_on_ties_and_cuts_before_rounding(spark):
    rows = [chunk(i, f"f{i}.py", "pass") for i in (9, 4, 7)]
    assert [c for c, _s, _r in fuse_one(spark, "zzz", [(9, 0.5, 0.0), (4, 0.5, 0.0), (7, 0.5, 0.0)], rows, k=2)] == [9, 4]
    assert fuse_one(spark, "zzz", [(9, 0.4999999, 0.0)], rows, low=0.35) == []


def test_fusion_drops_what_cannot_be_cited(spark):
    rows = [chunk(1, ".gitkeep", "# keep"), chunk(2, ".gitignore", "*.log"), chunk(3, "a.py", "# one\n# two"), chunk(4, "b.py", "# x", "one")]
    cands = [(i, 0.5, 0.5) for i in (1, 2, 3, 4)]
    assert [c for c, _s, _r in fuse_one(spark, "one", cands, rows)] == [4]
    assert [c for c, _s, _r in fuse_one(spark, "what does the .gitignore exclude", cands, rows)] == [2]


def test_symbol_adds_the_keyword_source_without_a_score(spark):
    assert fuse_one(spark, "main", [(1, 0.0, 0.0)], [chunk(1, "q.py", "pass", "Main")]) == [(1, 0.2, ["keyword"])]


def test_overview_list(spark):
    rows = [chunk(1, "main.py", "x", "main"), chunk(2, "README.md", "# Hi", "Hi"), chunk(3, "README.md", "# Features", "Features", start=9),
            chunk(4, "src/renderer.py", "x")]
    asked = [ask(1, "Explain the architecture."), ask(2, "Explain the architecture.", exts=[".py"]), ask(3, "where is main")]
    got = overview.overview_search(spark.createDataFrame(asked, QUERY), spark.createDataFrame(rows, CHUNK), limit=2)
    assert [(r.query_id, r.chunk_id, r.sem_score) for r in got.orderBy("rank").collect()] == [(1, 2, 0.0), (1, 3, 0.0)]


RUN = "id int, repository_id int, status string, created_at timestamp_ntz"


def test_search_reads_the_latest_completed_run_only(spark):
    from datetime import datetime as dt

    rows = [chunk(1, "a.py", "verify token", run=1), chunk(2, "b.py", "verify token", run=2), chunk(3, "b.py", "verify token", run=3)]
    runs = spark.createDataFrame(
        [(1, 1, "completed", dt(2026, 1, 1)), (2, 1, "completed", dt(2026, 1, 2)), (3, 1, "failed", dt(2026, 1, 3)), (4, 2, "failed", dt(2026, 1, 3))], RUN
    )
    asked = spark.createDataFrame([(1, 1, "verify token", "keyword"), (2, 2, "verify", "keyword")], "query_id long, repository_id int, query string, mode string")
    chunks = spark.createDataFrame(rows, CHUNK)
    found = search(asked, chunks, runs).collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [(1, 2)]
    assert found[0].score == pytest.approx(0.3)
    assert [r.query_id for r in not_indexed(with_defaults(asked), runs).collect()] == [2]


def test_large_request_tables_give_the_same_answers(spark):
    rows, queries = corpus(11)
    chunks = spark.createDataFrame(rows, CHUNK)
    runs = spark.sql("SELECT 1 AS id, explode(array(1, 2)) AS repository_id, 'completed' AS status, current_timestamp() AS created_at")
    asked = spark.createDataFrame(queries, QUERY).drop("ingestion_id", "candidate_k")
    order = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert order(search(asked, chunks, runs)) == order(search(asked, chunks, runs, broadcast_rows=0))


def test_exact_symbol_ranks_first_and_absent_words_keep_scores_low(spark):
    rows = [chunk(1, "a.py", "def setup_logger(): pass", "setup_logger"), chunk(2, "b.py", "verify_token checks", "verify_token"),
            chunk(3, "c.py", "calls verify_token", "verify_signature"), chunk(4, "d.py", "processed images", "ImageEncoder")]
    asked = spark.createDataFrame([ask(1, "verify_token"), ask(2, "how are stripe payment refunds processed")], QUERY)
    got = keyword.keyword_search(asked, spark.createDataFrame(rows, CHUNK)).orderBy("query_id", "rank").collect()
    assert [(r.chunk_id, r.lex_score) for r in got if r.query_id == 1] == [(2, 1.0), (3, 1.0)]
    assert all(fixed.WEIGHT_LEXICAL * r.lex_score < fixed.MIN_RELEVANCE for r in got if r.query_id == 2)


def test_approximate_search_recall(spark):
    draw = random.Random(3)
    centers = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    near = lambda: [x + draw.gauss(0, 0.3) for x in draw.choice(centers)]
    chunks = spark.createDataFrame([chunk(i, f"f{i}", "t", None, near()) for i in range(400)], CHUNK)
    asked = spark.createDataFrame([ask(i, "q", near(), 5) for i in range(20)], QUERY)
    groups = approximate.fit_groups(chunks, 6)
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact = pairs(semantic.semantic_search(asked, chunks))
    some = pairs(approximate.approx_semantic_search(asked, chunks, groups, 2))
    assert len(exact & some) / len(exact) >= 0.9
    assert pairs(approximate.approx_semantic_search(asked, chunks, groups, 6)) == exact


def test_posting_lists_round_trip():
    draw = random.Random(8)
    for size in (0, 1, 127, 128, 129, 1000):
        for most in (300, 70_000, 1 << 33, (1 << 62) - 1):
            ids = np.array(sorted({draw.randint(-most, most) for _ in range(size)}), np.int64)
            stored = inverted.PostingList(*inverted.encode(ids))
            assert stored.ids().tolist() == ids.tolist()
            wanted = np.array(sorted({*draw.sample(ids.tolist(), len(ids) // 3), *(draw.randint(-most, most) for _ in range(20))}), np.int64)
            assert stored.contains(wanted).tolist() == [i in set(ids.tolist()) for i in wanted.tolist()]
    far = inverted.PostingList(*inverted.encode(np.arange(0, 100_000, 7)))
    far.contains(np.array([7, 8, 99_995]))
    assert far.decoded - 0 == 2  # two of 112 blocks


@pytest.mark.parametrize("k", [1, 3, 20])
def test_best_of_shard_equals_all_sums(k):
    draw = random.Random(k)
    for _ in range(60):
        units = [draw.choice([1, 2, 5, 40, 40, 300]) for _ in range(draw.randint(1, 8))]
        lists = [sorted(draw.sample(range(400), draw.randint(0, 1 + 1200 // u % 399))) for u in units]
        allowed = None if draw.random() < 0.5 else sorted(draw.sample(range(400), 150))
        sums = {}
        for u, ids in zip(units, lists, strict=True):
            for i in ids:
                if allowed is None or i in allowed:
                    sums[i] = sums.get(i, 0) + u
        want = sorted(sums.items(), key=lambda s: (-s[1], s[0]))[:k]
        packed = [inverted.PostingList(*inverted.encode(np.array(ids, np.int64))) for ids in lists]
        ids, got, formed = inverted.best_of_shard(packed, units, k, None if allowed is None else np.array(allowed))
        assert list(zip(ids.tolist(), got.tolist(), strict=True)) == want
        assert formed <= len(sums)


def test_the_threshold_keeps_chunks_of_frequent_terms_from_being_formed():
    rare, common = np.arange(0, 400, 10), np.arange(20_000)
    packed = [inverted.PostingList(*inverted.encode(x)) for x in (common, rare)]
    ids, _sums, formed = inverted.best_of_shard(packed, [3, 50], 10, None)
    # The k-th best score is 53 after the rare term; a chunk with the common term alone has 3 and is never formed.
    assert formed == len(rare) and ids.tolist() == list(range(0, 100, 10))
    assert packed[0].decoded <= 4


@pytest.mark.parametrize("seed, small", [(1, True), (2, False)])
def test_the_kept_index_gives_the_same_result(spark, tmp_path, monkeypatch, seed, small):
    monkeypatch.setattr(inverted, "SHARD", 16)
    monkeypatch.setattr(inverted, "BLOCK", 4)
    rows, queries = corpus(seed)
    chunks, asked = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(queries, QUERY)
    inverted.write_index(inverted.posting_lists(keyword.build_postings(chunks), chunks), str(tmp_path / "index"))
    index = inverted.read_index(spark, str(tmp_path / "index"))
    assert index.select("shard").distinct().count() > 3
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(keyword.keyword_search(asked, chunks, small=small))
    blind = chunks.withColumn("chunk_text", F.lit("the index is read, not this"))
    assert order(keyword.keyword_search(asked, blind, small=small, index=index)) == want
    terms = {r.query_id: sorted({t.lower() for t in r.t}) for r in asked.select("query_id", tx.lexical_terms(F.col("query")).alias("t")).collect()}
    got = {}
    for q, c, s, _r in sorted(want, key=lambda r: (r[0], r[3])):
        got.setdefault(q, []).append((c, pytest.approx(s, abs=1e-9)))
    for q in queries:
        assert keyword_by_hand(rows, q, terms[q[0]]) == got.get(q[0], [])


def test_a_new_run_replaces_the_lists_of_its_repository_only(spark, tmp_path):
    target = str(tmp_path / "index")
    write = lambda rows: inverted.write_index(inverted.posting_lists(keyword.build_postings(df := spark.createDataFrame(rows, CHUNK)), df), target)
    write([chunk(1, "a.py", "old words", run=1), chunk(2, "b.py", "other", repo=2, run=1)])
    write([chunk(3, "a.py", "new words", run=2)])
    found = {(r.repository_id, r.ingestion_id, r.match_key) for r in inverted.read_index(spark, target).collect()}
    assert (1, 2, "new") in found and (2, 1, "other") in found and not any(r == 1 and i == 1 for r, i, _ in found)


def test_each_request_has_its_own_limit_and_invalid_ones_get_their_reasons(spark):
    from datetime import datetime as dt

    rows = [chunk(i, f"f{i}.py", f"verify token {i}") for i in range(80)]
    runs = spark.createDataFrame([(1, 1, "completed", dt(2026, 1, 1))], RUN)
    asked = spark.createDataFrame(
        [(1, 1, "verify token", "keyword", 70), (2, 1, "", "keyword", 5), (3, 1, "token", "keyword", 3), (4, 1, "token", "odd", 0), (5, 1, "token", "keyword", 71)],
        "query_id long, repository_id int, query string, mode string, top_k int",
    )
    found, refused = answer_requests(asked, spark.createDataFrame(rows, CHUNK), runs, max_top_k=70)
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert counts == {1: 70, 3: 3}
    reasons = {r["query_id"]: sorted(r["errors"]) for r in refused.collect()}
    assert reasons == {2: ["query_empty"], 4: ["mode_unknown", "top_k_out_of_range"], 5: ["top_k_out_of_range"]}


def clustered(seed=3, n=600, width=32):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    near = lambda: [x + draw.gauss(0, 0.4) for x in draw.choice(centers)]
    rows = [chunk(i, draw.choice(["src/", "docs/"]) + f"f{i}.py", "t", None, near() if i % 9 else None, repo=1 + (i % 5 == 0)) for i in range(n)]
    asked = [ask(i, "q", near(), 5, repo=1 + i % 2, paths=["src/"] if i % 3 == 0 else None) for i in range(24)]
    return rows, asked


def test_stored_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_lists, "TOGETHER", 10)
    rows, queries = clustered()
    chunks, asked = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(queries, QUERY)
    lists = vector_lists.fit_lists(chunks, 8, 8)
    vector_lists.write_lists(vector_lists.coded(chunks, lists), str(tmp_path / "lists"))
    stored = vector_lists.read_lists(spark, str(tmp_path / "lists"))
    pairs = lambda df: {(r.query_id, r.chunk_id, round(r.sem_score, 9), r.rank) for r in df.collect()}
    exact = pairs(semantic.semantic_search(asked, chunks))
    assert pairs(vector_lists.lists_search(asked, stored, lists, 8, None)) == exact
    some = {(q, c) for q, c, *_ in pairs(vector_lists.lists_search(asked, stored, lists, 3))}
    assert len(some & {(q, c) for q, c, *_ in exact}) / len(exact) >= 0.9
    assert vector_lists.lists_search(asked.limit(0), stored, lists, 3).collect() == []


def test_a_search_opens_only_the_lists_that_it_probes(spark, tmp_path):
    rows, queries = clustered(5)
    chunks = spark.createDataFrame(rows, CHUNK)
    lists = vector_lists.fit_lists(chunks, 8, 4)
    vector_lists.write_lists(vector_lists.coded(chunks, lists), str(tmp_path / "lists"))
    stored = vector_lists.read_lists(spark, str(tmp_path / "lists"))
    one = spark.createDataFrame(queries[1:2], QUERY)
    plan = vector_lists.lists_search(one, stored, lists, 2)._jdf.queryExecution().toString()
    filters = re.findall(r"PartitionFilters: \[[^\]]*list#\d+ IN \((\d+),(\d+)\)", plan)
    assert filters and all(a != b for a, b in filters) and "code" in plan


def test_fused_rows_are_fetched_by_their_keys(spark, monkeypatch):
    """Beyond the broadcast only rows that a filter of candidate keys lets pass meet the join; the result is the same."""
    rows, queries = corpus(21)
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame(queries, QUERY)
    merged = fusion.merge_candidates(
        fusion.candidate_list(semantic.semantic_search(asked, chunks), fusion.SEMANTIC),
        fusion.candidate_list(keyword.keyword_search(asked, chunks), fusion.KEYWORD),
    )
    order = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    want = order(fusion.fuse(merged, asked, chunks, small=True))
    assert order(fusion.fuse(merged, asked, chunks, small=False)) == want
    monkeypatch.setattr(fusion, "FILTER_KEYS", 3)  # more candidates than a filter may have
    assert order(fusion.fuse(merged, asked, chunks, small=False)) == want
    keys = spark.createDataFrame([(i,) for i in range(0, 4000, 40)], "chunk_id long")
    passed = fusion.with_candidate_keys(spark.range(4000).withColumnRenamed("id", "chunk_id"), keys, 100)
    assert 100 <= passed.count() < 250 and passed.join(keys, "chunk_id", "left_semi").count() == 100
