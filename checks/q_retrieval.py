"""Retrieval: joins, aggregates, top-k, fusion (RET, JN-1 to JN-6, AGG-7 to AGG-9, WIN, SRT, SET)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sqltext as q
from checks.corpus import table, with_tables
from checks.registry import query
from codelode.operators import approximate, fusion, inverted, keyword, overview, ranking, semantic
from codelode.plans.search import not_indexed, resolve_runs, search, with_defaults
from codelode.session import pin_small, shared_folder

# ---- the same retrieval written in SQL -------------------------------------

ASKED = with_tables("requests", "chunks") + """,
asked AS (SELECT r.*, l.ingestion_id, r.top_k * 2 AS candidate_k
  FROM requests r JOIN latest l USING (repository_id)),
scoped AS (SELECT c.* FROM chunks c JOIN latest l
  ON c.repository_id = l.repository_id AND c.ingestion_id = l.ingestion_id)"""

SEMANTIC = ASKED + f""",
sem_all AS (SELECT a.query_id, c.chunk_id, a.candidate_k, round(greatest(0.0, least(1.0,
    list_cosine_similarity(a.query_vector::DOUBLE[], c.embedding::DOUBLE[]))), 12) AS sem_score
  FROM asked a JOIN scoped c USING (repository_id)
  WHERE a.mode IN ('hybrid', 'semantic') AND c.embedding IS NOT NULL AND a.query_vector IS NOT NULL
    AND {q.passes('c.file_path', 'a.file_extensions', 'a.file_paths')}),
sem AS (SELECT query_id, chunk_id, sem_score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY sem_score DESC, chunk_id) AS rank FROM sem_all) WHERE rank <= candidate_k)"""

_BLOB = "lower(concat(coalesce(c.name, ''), ' ', c.file_path, ' ', c.chunk_text))"
TERMS = f""",
query_terms AS (SELECT DISTINCT query_id, repository_id, term, regexp_full_match(term, '[a-z0-9]+') AS plain,
    {q.fold('term')} AS folded
  FROM (SELECT query_id, repository_id, unnest({q.terms('query')}) AS term FROM asked WHERE mode IN ('hybrid', 'keyword'))),
hay AS (SELECT c.chunk_id, c.repository_id, {_BLOB} AS blob, list_distinct(list_transform(
    regexp_extract_all({_BLOB}, '[a-z0-9]+'), lambda w: {q.fold('w')})) AS words FROM scoped c),
matches AS (SELECT DISTINCT t.repository_id, t.term, h.chunk_id FROM
    (SELECT DISTINCT repository_id, term, plain, folded FROM query_terms) t JOIN hay h USING (repository_id)
  WHERE CASE WHEN plain THEN list_contains(h.words, t.folded) ELSE contains(h.blob, t.term) END)"""
WEIGHTS = TERMS + """,
sizes AS (SELECT repository_id, count(*) AS n FROM scoped GROUP BY 1),
freq AS (SELECT t.repository_id, t.term, s.n, count(m.chunk_id) AS df
  FROM (SELECT DISTINCT repository_id, term FROM query_terms) t JOIN sizes s USING (repository_id)
    LEFT JOIN matches m ON m.repository_id = t.repository_id AND m.term = t.term GROUP BY 1, 2, 3),
weights AS (SELECT t.query_id, t.repository_id, t.term,
    CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * 1000000000000) AS BIGINT) AS units
  FROM query_terms t JOIN freq USING (repository_id, term)),
totals AS (SELECT query_id, sum(units) AS total FROM weights GROUP BY 1)"""
LEXICAL = WEIGHTS + f""",
exact AS (SELECT a.query_id, c.chunk_id FROM asked a JOIN scoped c USING (repository_id)
  WHERE a.mode IN ('hybrid', 'keyword') AND c.name <> '' AND lower(c.name) = lower({q.strip('a.query')})),
lex_pairs AS (SELECT query_id, chunk_id, max(s) AS lex_score FROM (
    SELECT w.query_id, m.chunk_id, CAST(sum(w.units) AS DOUBLE) / CAST(max(t.total) AS DOUBLE) AS s
    FROM weights w JOIN matches m ON m.repository_id = w.repository_id AND m.term = w.term
      JOIN totals t ON t.query_id = w.query_id GROUP BY 1, 2
    UNION ALL SELECT query_id, chunk_id, 1.0 FROM exact) GROUP BY 1, 2),
lex AS (SELECT query_id, chunk_id, lex_score, rank FROM (SELECT p.*, a.candidate_k, row_number() OVER
    (PARTITION BY p.query_id ORDER BY lex_score DESC, p.chunk_id) AS rank
  FROM lex_pairs p JOIN asked a USING (query_id) JOIN scoped c ON c.chunk_id = p.chunk_id
  WHERE {q.passes('c.file_path', 'a.file_extensions', 'a.file_paths')}) WHERE rank <= candidate_k)"""
OVERVIEW = f""",
tops AS (SELECT repository_id, chunk_id, embedding, rank FROM (SELECT *, row_number() OVER (PARTITION BY repository_id
    ORDER BY {q.overview_rank('file_path')}, lower(file_path), start_line, chunk_id) AS rank
  FROM scoped WHERE {q.overview('file_path', 'name', 'start_line')}) WHERE rank <= 8),
over AS (SELECT a.query_id, t.chunk_id, t.rank, CASE WHEN a.mode = 'keyword' OR a.query_vector IS NULL OR t.embedding IS NULL
    THEN 0.0 ELSE round(greatest(0.0, least(1.0, list_cosine_similarity(a.query_vector::DOUBLE[], t.embedding::DOUBLE[]))), 12)
    END AS sem_score
  FROM asked a JOIN tops t USING (repository_id)
  WHERE {q.broad('a.query')} AND a.file_extensions IS NULL AND a.file_paths IS NULL)"""
MERGED = SEMANTIC + LEXICAL + OVERVIEW + """,
merged AS (SELECT query_id, chunk_id, max(sem_score) AS sem_score, max(lex_score) AS lex_score,
    min(place) AS place FROM (
  SELECT query_id, chunk_id, sem_score, 0.0 AS lex_score, rank AS place FROM sem UNION ALL
  SELECT query_id, chunk_id, sem_score, 0.0, 1000 + rank FROM over UNION ALL
  SELECT query_id, chunk_id, 0.0, lex_score, 2000 + rank FROM lex) GROUP BY 1, 2)"""
FUSED = MERGED + f""",
signals AS (SELECT m.*, a.query, a.top_k, a.min_score, c.file_path, c.name, c.start_line, c.end_line, c.language,
    coalesce(c.chunk_type, 'block') AS chunk_type, c.chunk_text,
    coalesce(c.name <> '' AND lower(c.name) = lower({q.strip('a.query')}), false) AS symbol,
    {q.broad('a.query')} AND {q.overview('c.file_path', 'c.name', 'c.start_line')} AS overview,
    m.sem_score::DOUBLE * 0.7::DOUBLE + m.lex_score::DOUBLE * 0.3::DOUBLE AS content
  FROM merged m JOIN asked a USING (query_id) JOIN scoped c USING (chunk_id)),
scored AS (SELECT *, least(1.0::DOUBLE, content + ((CASE WHEN symbol THEN 0.2::DOUBLE ELSE 0.0 END)
    + (CASE WHEN content >= 0.05 AND {q.path_matches('file_path', 'lower(query)')} THEN 0.1::DOUBLE ELSE 0.0 END)
    + (CASE WHEN overview THEN 0.15::DOUBLE ELSE 0.0 END))) AS raw
  FROM signals WHERE symbol OR NOT {q.non_evidence('chunk_text', 'file_path', 'query')}),
fused AS (SELECT *, round(raw, 6) AS score,
    array_to_string(list_filter([CASE WHEN sem_score > 0 THEN 'semantic' END,
      CASE WHEN lex_score > 0 OR symbol THEN 'keyword' END, CASE WHEN overview THEN 'overview' END],
      lambda x: x IS NOT NULL), ',') AS sources
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, place, chunk_id) AS rank
    FROM scored WHERE min_score IS NULL OR raw >= min_score) WHERE rank <= top_k)"""


# ---- inputs -----------------------------------------------------------------


def asked(spark, sf_dir, *modes):
    resolved = resolve_runs(with_defaults(table(spark, sf_dir, "requests")), table(spark, sf_dir, "runs"))
    rows, _small = pin_small(resolved.where(F.col("ingestion_id").isNotNull()))
    return rows.where(F.col("mode").isin(*modes)) if modes else rows


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "chunks")


def lexical_parts(spark, sf_dir):
    """(queries, terms, matches, chunks) of the keyword retriever."""
    queries = asked(spark, sf_dir, "hybrid", "keyword")
    stored = chunks(spark, sf_dir)
    terms = keyword.query_terms(queries)
    matches = keyword.term_matches(terms, keyword.build_postings(stored), small=False)
    return queries, terms, matches, stored


# ---- queries ------------------------------------------------------------------


@query("ret_1_semantic", SEMANTIC + " SELECT query_id, chunk_id, round(sem_score, 6) AS sem_score, rank FROM sem")
def ret_1(spark, sf_dir):
    found = semantic.semantic_search(asked(spark, sf_dir, "hybrid", "semantic"), chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("sem_score", 6).alias("sem_score"), "rank")


@query("ret_1_semantic_cells", SEMANTIC + " SELECT query_id, chunk_id, round(sem_score, 6) AS sem_score, rank FROM sem")
def ret_1_cells(spark, sf_dir):
    found = semantic.semantic_search(
        asked(spark, sf_dir, "hybrid", "semantic"), chunks(spark, sf_dir), broadcast_rows=0
    )
    return found.select("query_id", "chunk_id", F.round("sem_score", 6).alias("sem_score"), "rank")


@query("ret_2_keyword", ASKED + LEXICAL + " SELECT query_id, chunk_id, round(lex_score, 6) AS lex_score, rank FROM lex")
def ret_2(spark, sf_dir):
    found = keyword.keyword_search(asked(spark, sf_dir, "hybrid", "keyword"), chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("lex_score", 6).alias("lex_score"), "rank")


@query("ret_2_keyword_index", ASKED + LEXICAL + " SELECT query_id, chunk_id, round(lex_score, 6) AS lex_score, rank FROM lex")
def ret_2_index(spark, sf_dir):
    """The same from an index that is written and read back; the search gets no chunk text."""
    stored, target = chunks(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    inverted.write_index(inverted.posting_lists(keyword.build_postings(stored, by_chunk=True), stored), target)
    found = keyword.keyword_search(
        asked(spark, sf_dir, "hybrid", "keyword"), stored.withColumn("chunk_text", F.lit(None).cast("string")),
        index=inverted.read_index(spark, target),
    )
    return found.select("query_id", "chunk_id", F.round("lex_score", 6).alias("lex_score"), "rank")


@query("ret_3_overview", ASKED + OVERVIEW + " SELECT query_id, chunk_id, round(sem_score, 6) AS sem_score, rank FROM over")
def ret_3(spark, sf_dir):
    queries = asked(spark, sf_dir)
    vector = F.when(F.col("mode") != "keyword", F.col("query_vector"))
    found = overview.overview_search(queries.withColumn("query_vector", vector), chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("sem_score", 6).alias("sem_score"), "rank")


def _merged(spark, sf_dir):
    queries, stored = asked(spark, sf_dir), chunks(spark, sf_dir)
    vector = F.when(F.col("mode") != "keyword", F.col("query_vector"))
    return fusion.merge_candidates(
        fusion.candidate_list(
            semantic.semantic_search(asked(spark, sf_dir, "hybrid", "semantic"), stored), fusion.SEMANTIC
        ),
        fusion.candidate_list(
            overview.overview_search(queries.withColumn("query_vector", vector), stored), fusion.OVERVIEW
        ),
        fusion.candidate_list(
            keyword.keyword_search(asked(spark, sf_dir, "hybrid", "keyword"), stored), fusion.KEYWORD
        ),
    )


@query("jn_1_merge_candidates", MERGED + """ SELECT query_id, chunk_id, round(sem_score, 6) AS sem_score,
  round(lex_score, 6) AS lex_score, CAST(place // 1000 AS INT) AS source, CAST(place % 1000 AS INT) AS source_rank FROM merged""")
def jn_1(spark, sf_dir):
    return _merged(spark, sf_dir).select(
        "query_id", "chunk_id", F.round("sem_score", 6).alias("sem_score"),
        F.round("lex_score", 6).alias("lex_score"), "first_seen.source", "first_seen.source_rank",
    )


@query("ret_4_fuse", FUSED + """ SELECT query_id, rank, chunk_id, file_path, score, sources FROM fused""")
def ret_4(spark, sf_dir):
    fused = fusion.fuse(_merged(spark, sf_dir), asked(spark, sf_dir), chunks(spark, sf_dir))
    return fused.select(
        "query_id", "rank", "chunk_id", "file_path", "score",
        F.array_join("retrieval_sources", ",").alias("sources"),
    )


@query("ret_5_search", FUSED + """ SELECT query_id, rank, chunk_id, file_path, start_line, end_line, language,
  chunk_type, name, score, sources FROM fused""")
def ret_5(spark, sf_dir):
    found = search(
        table(spark, sf_dir, "requests"), chunks(spark, sf_dir), table(spark, sf_dir, "runs")
    )
    return found.select(
        "query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "language", "chunk_type",
        "name", "score", F.array_join("retrieval_sources", ",").alias("sources"),
    )


@query("ret_5_not_indexed", with_tables("requests", "runs") + """ SELECT query_id, repository_id, 'not_indexed' AS status
  FROM requests WHERE repository_id NOT IN (SELECT repository_id FROM runs WHERE status = 'completed' AND id % 37 = 0)""")
def ret_5_not_indexed(spark, sf_dir):
    runs = table(spark, sf_dir, "runs").withColumn(
        "status", F.when(F.col("id") % 37 == 0, F.col("status")).otherwise("failed")
    )
    return not_indexed(with_defaults(table(spark, sf_dir, "requests")), runs)


@query("jn_2_current_run", ASKED + " SELECT chunk_id, repository_id, ingestion_id FROM scoped")
def jn_2(spark, sf_dir):
    current = ranking.latest_run(table(spark, sf_dir, "runs")).select(
        "repository_id", F.col("id").alias("ingestion_id")
    )
    return chunks(spark, sf_dir).join(current, ["repository_id", "ingestion_id"], "left_semi").select(
        "chunk_id", "repository_id", "ingestion_id"
    )


@query("jn_3_vectors_in_scope", SEMANTIC + " SELECT query_id, max(sem_score) AS best FROM sem GROUP BY 1")
def jn_3(spark, sf_dir):
    partial = semantic.semantic_scores(asked(spark, sf_dir, "hybrid", "semantic"), chunks(spark, sf_dir))
    return partial.groupBy("query_id").agg(F.max("sem_score").alias("best"))




@query("jn_4_term_matches", ASKED + TERMS + " SELECT repository_id, term, chunk_id FROM matches WHERE regexp_full_match(term, '[a-z0-9]+')")
def jn_4(spark, sf_dir):
    _q, _t, matches, _c = lexical_parts(spark, sf_dir)
    return matches.where(F.col("term").rlike(r"\A[a-z0-9]+\z")).select("repository_id", "term", "chunk_id")


@query("jn_5_substring_matches", ASKED + TERMS + " SELECT repository_id, term, chunk_id FROM matches WHERE NOT regexp_full_match(term, '[a-z0-9]+')")
def jn_5(spark, sf_dir):
    _q, _t, matches, _c = lexical_parts(spark, sf_dir)
    return matches.where(~F.col("term").rlike(r"\A[a-z0-9]+\z")).select("repository_id", "term", "chunk_id")


@query("jn_6_exact_symbol", ASKED + LEXICAL + " SELECT query_id, chunk_id FROM exact")
def jn_6(spark, sf_dir):
    return keyword.symbol_matches(
        asked(spark, sf_dir, "hybrid", "keyword"), chunks(spark, sf_dir).join(
            asked(spark, sf_dir).select("repository_id", "ingestion_id").distinct(),
            ["repository_id", "ingestion_id"], "left_semi"), small=False
    ).select("query_id", "chunk_id")


@query("agg_7_document_frequency", ASKED + WEIGHTS + " SELECT repository_id, term, df, n FROM freq")
def agg_7(spark, sf_dir):
    _q, terms, matches, stored = lexical_parts(spark, sf_dir)
    return keyword.document_frequency(terms, matches, stored).select("repository_id", "term", "df", "n")


@query("agg_8_term_coverage", ASKED + LEXICAL + " SELECT query_id, chunk_id, round(lex_score, 6) AS lex_score FROM lex_pairs")
def agg_8(spark, sf_dir):
    scored = keyword.keyword_scores(asked(spark, sf_dir, "hybrid", "keyword"), chunks(spark, sf_dir))
    return scored.select("query_id", "chunk_id", F.round("lex_score", 6).alias("lex_score"))


@query("agg_9_max_merge", MERGED + """ SELECT query_id, count(*) AS candidates, round(max(sem_score), 6) AS sem,
  round(max(lex_score), 6) AS lex FROM merged GROUP BY 1""")
def agg_9(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.round(F.max("sem_score"), 6).alias("sem"),
        F.round(F.max("lex_score"), 6).alias("lex"),
    )


@query("win_4_top_k", """SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER
  (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank,
  3 + CAST(substr(source, 4) AS INT) % 5 AS k FROM documents) WHERE rank <= k""")
def win_4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    k = F.lit(3) + F.substring("source", 4, 9).cast("int") % 5
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return ranking.top_k(docs, ["source"], order, 7, k).select("source", "doc_id", "rank")


@query("win_8_first_seen", MERGED + " SELECT query_id, chunk_id, place // 1000 AS source FROM merged")
def win_8(spark, sf_dir):
    return _merged(spark, sf_dir).select("query_id", "chunk_id", "first_seen.source")


@query("srt_1_candidate_limit", SEMANTIC + LEXICAL + """ SELECT a.query_id, a.candidate_k,
  (SELECT count(*) FROM sem WHERE sem.query_id = a.query_id) AS semantic,
  (SELECT count(*) FROM lex WHERE lex.query_id = a.query_id) AS keyword FROM asked a""")
def srt_1(spark, sf_dir):
    queries, stored = asked(spark, sf_dir), chunks(spark, sf_dir)
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    sem = count(semantic.semantic_search(asked(spark, sf_dir, "hybrid", "semantic"), stored), "semantic")
    lex = count(keyword.keyword_search(asked(spark, sf_dir, "hybrid", "keyword"), stored), "keyword")
    return queries.select("query_id", "candidate_k").join(sem, "query_id", "left").join(
        lex, "query_id", "left").na.fill(0, ["semantic", "keyword"])


@query("srt_2_keyword_order", ASKED + LEXICAL + " SELECT query_id, chunk_id, rank FROM lex")
def srt_2(spark, sf_dir):
    return keyword.keyword_search(
        asked(spark, sf_dir, "hybrid", "keyword"), chunks(spark, sf_dir)
    ).select("query_id", "chunk_id", "rank")


@query("srt_3_overview_order", ASKED + OVERVIEW + " SELECT repository_id, chunk_id, rank FROM tops")
def srt_3(spark, sf_dir):
    current = asked(spark, sf_dir).select("repository_id", "ingestion_id").distinct()
    stored = chunks(spark, sf_dir).join(current, ["repository_id", "ingestion_id"], "left_semi")
    return overview.overview_chunks(stored).select("repository_id", "chunk_id", "rank")


@query("set_1_union_lists", SEMANTIC + LEXICAL + OVERVIEW + """ SELECT query_id, chunk_id, 0 AS source FROM sem UNION ALL
  SELECT query_id, chunk_id, 1 FROM over UNION ALL SELECT query_id, chunk_id, 2 FROM lex""")
def set_1(spark, sf_dir):
    queries, stored = asked(spark, sf_dir), chunks(spark, sf_dir)
    lists = [
        fusion.candidate_list(semantic.semantic_search(asked(spark, sf_dir, "hybrid", "semantic"), stored), fusion.SEMANTIC),
        fusion.candidate_list(overview.overview_search(queries, stored), fusion.OVERVIEW),
        fusion.candidate_list(keyword.keyword_search(
            asked(spark, sf_dir, "hybrid", "keyword"), stored), fusion.KEYWORD),
    ]
    rows = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return rows.select("query_id", "chunk_id", "source")


@query("set_3_source_set", FUSED + " SELECT sources, count(*) AS results FROM fused GROUP BY 1")
def set_3(spark, sf_dir):
    found = search(table(spark, sf_dir, "requests"), chunks(spark, sf_dir), table(spark, sf_dir, "runs"))
    return found.groupBy(F.array_join("retrieval_sources", ",").alias("sources")).agg(
        F.count(F.lit(1)).alias("results")
    )




@query("ret_6_approximate")
def ret_6(spark, sf_dir):
    stored = chunks(spark, sf_dir)
    groups = approximate.fit_groups(stored, 8)
    found = approximate.approx_semantic_search(asked(spark, sf_dir, "hybrid", "semantic"), stored, groups, 4)
    return found.select("query_id", "chunk_id", F.round("sem_score", 6).alias("sem_score"), "rank")


@query("ret_6_all_groups", SEMANTIC + " SELECT query_id, chunk_id, round(sem_score, 6) AS sem_score, rank FROM sem")
def ret_6_all(spark, sf_dir):
    stored = chunks(spark, sf_dir)
    groups = approximate.fit_groups(stored, 8)
    found = approximate.approx_semantic_search(asked(spark, sf_dir, "hybrid", "semantic"), stored, groups, 8)
    return found.select("query_id", "chunk_id", F.round("sem_score", 6).alias("sem_score"), "rank")
