"""Files: filters, scalar functions, profiles (FLT, FN, AGG-1 to AGG-6, RUN-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as q
from checks.corpus import binary_tree, table, with_tables
from checks.registry import query
from codelode.functions import text as tx, urls, vectors as vx
from codelode.operators import filters, profile

FILES = with_tables("files")
SMALL_FILE = 4096


def _column(name: str, key: str, expr, sql: str, source: str = "files", alias: str = "value") -> None:
    """A one-expression check: ``key`` and the expression, over all of ``source``."""

    @query(name, f"{with_tables(source)} SELECT {key}, {sql} AS {alias} FROM {source}"
           if source in ("files", "runs", "requests", "chunks")
           else f"SELECT {key}, {sql} AS {alias} FROM {source}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, expr().alias(alias))


PATH, TEXT = "path", "text"
_column("flt_1_ignored_dir", "doc_id", lambda: tx.in_ignored_dir(F.col(PATH)), q.ignored_dir(PATH))
_column("flt_2_secret_file", "doc_id", lambda: tx.is_secret_file(F.col(PATH)), q.secret(PATH))
_column("flt_3_binary_extension", "doc_id", lambda: tx.has_binary_extension(F.col(PATH)), q.binary_extension(PATH))
_column("flt_4_exceeds_size", "doc_id", lambda: F.col("length") > SMALL_FILE, f"length > {SMALL_FILE}")
_column("flt_10_comment_only", "chunk_id",
        lambda: tx.is_comment_only(F.col("chunk_text"), F.col("file_path")),
        q.comment_only("chunk_text", "file_path"), "chunks")
_column("flt_11_non_evidence", "chunk_id",
        lambda: tx.is_non_evidence(
            F.col("chunk_text"), F.col("file_path"),
            F.when(F.col("chunk_id") % 2 == 0, F.lit("what does the gitignore doc exclude"))
            .otherwise(F.col("chunk_text"))),
        q.non_evidence("chunk_text", "file_path",
                       "CASE WHEN chunk_id % 2 = 0 THEN 'what does the gitignore doc exclude' "
                       "ELSE chunk_text END"), "chunks")
_column("flt_15_overview_chunk", "chunk_id",
        lambda: tx.is_overview_chunk(F.col("file_path"), F.col("name"), F.col("start_line")),
        q.overview("file_path", "name", "start_line"), "chunks")
_column("flt_16_broad_question", "query_id", lambda: tx.is_broad_question(F.col("query")),
        q.broad("query"), "requests")
_column("fn_1_detect_language", "doc_id", lambda: tx.detect_language(F.col(PATH)), q.language(PATH))
_column("fn_2_line_count", "doc_id", lambda: tx.line_count(F.col(TEXT)), q.line_count(TEXT))
_column("fn_3_top_dir", "doc_id", lambda: tx.top_dir(F.col(PATH)), q.top_dir(PATH))
_column("fn_4_content_hash", "doc_id", lambda: tx.content_hash(F.col(TEXT)), f"sha256({q.strip(TEXT)})")
_column("fn_5_path_words", "doc_id", lambda: F.array_join(F.array_sort(tx.path_words(F.col(PATH))), " "),
        f"array_to_string(list_sort(list_distinct({q.path_words(PATH)})), ' ')")
_column("fn_5_query_words", "query_id",
        lambda: F.array_join(F.array_sort(tx.path_match_terms(F.col("query"))), " "),
        f"array_to_string(list_sort(list_distinct({q.path_terms('query')})), ' ')", "requests")
_column("fn_6_path_matches", "doc_id",
        lambda: tx.path_matches_query(F.col(PATH), F.col(TEXT)),
        q.path_matches(PATH, "text"))
_column("fn_7_lexical_terms", "conv_id, turn".split(",")[0],
        lambda: F.array_join(F.array_sort(F.transform(tx.lexical_terms(F.col(TEXT)), F.lower)), " "),
        f"array_to_string(list_sort(list_distinct({q.terms(TEXT)})), ' ')", "conversations")
_column("set_2_distinct_terms", "query_id", lambda: F.size(tx.lexical_terms(F.col("query"))),
        f"CAST(len(list_distinct({q.terms('query')})) AS INT)", "requests")
_column("fn_9_fold", "doc_id", lambda: F.array_join(F.transform(F.split(F.lower(F.col(TEXT)), " "), tx.fold), " "),
        f"array_to_string(list_transform(string_split(lower(text), ' '), lambda w: {q.fold('w')}), ' ')")
_column("fn_10_estimate_tokens", "doc_id", lambda: tx.estimate_tokens(F.col(TEXT)), q.tokens(TEXT))
_column("fn_11_embedding_tokens", "doc_id", lambda: tx.estimate_embedding_tokens(F.col(TEXT)),
        "greatest(1, CAST(floor(length(text) / 3.5) AS BIGINT) + 1)")
_column("fn_17_snippet", "doc_id", lambda: tx.snippet(F.col(TEXT)), "left(text, 500)")


@query("fn_8_idf_weight", f"""{FILES}, n AS (SELECT repository_id, count(*) AS n FROM files GROUP BY 1),
  d AS (SELECT repository_id, lang, count(*) AS df FROM files GROUP BY 1, 2)
  SELECT repository_id, lang, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS weight
  FROM d JOIN n USING (repository_id)""")
def idf_weight(spark, sf_dir):
    from codelode.functions.scores import idf_weight as weight

    files = table(spark, sf_dir, "files")
    df = files.groupBy("repository_id", "lang").agg(F.count(F.lit(1)).alias("df"))
    n = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "repository_id").select(
        "repository_id", "lang", F.round(weight(F.col("df"), F.col("n")), 6).alias("weight")
    )


@query("flt_5_binary_content", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true
  WHEN 2 THEN false ELSE false END AS is_binary FROM documents""")
def binary_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("binary")
    # A zero byte; mostly control bytes after a bad one; one bad byte; plain text.
    content = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("4100")), text))
        .when(F.col("doc_id") % 5 == 1, F.unhex(F.repeat(F.lit("FF0102"), 500)))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.unhex(F.lit("FF")), text))
        .otherwise(text)
    )
    return docs.select("doc_id", tx.is_binary_content(content).alias("is_binary"))


@query("flt_6_file_verdict", f"""{FILES} SELECT doc_id, {q.verdict(PATH, 'length', SMALL_FILE)} AS reason,
  ({q.verdict(PATH, 'length', SMALL_FILE)}) IS NOT NULL AS ignored FROM files""")
def file_verdict(spark, sf_dir):
    files = table(spark, sf_dir, "files").withColumn("content", F.col("text").cast("binary"))
    return filters.file_verdict(files, SMALL_FILE).select("doc_id", "reason", "ignored")


CHUNKS = with_tables("chunks")


@query("flt_7_by_extension", f"{CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE file_path LIKE '%.md' OR file_path LIKE '%.go'")
def by_extension(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "file_path")
    return filters.by_extension(chunks, [".md", "go"])


@query("flt_8_by_path_prefix", f"{CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE file_path LIKE 'docs/%' OR file_path LIKE '__/doc%'")
def by_path_prefix(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "file_path")
    return filters.by_path_prefix(chunks, ["docs/", "__/doc"])


@query("flt_9_scope", f"{CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE repository_id = 'src3' AND ingestion_id = -1")
def scope(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    return filters.scope(chunks, repository_id="src3", ingestion_id=-1).select("chunk_id", "file_path")


@query("flt_12_min_score", "SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS score FROM documents WHERE doc_id % 100 >= 11")
def min_score(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", ((F.col("doc_id") % 100) / 100.0).alias("score")
    )
    return filters.min_score(rows, 0.11)


@query("flt_13_non_blank", r"""SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0
  THEN regexp_replace(text, '\S', ' ', 'g') ELSE text END AS t FROM documents)
  WHERE regexp_matches(t, '\S')""")
def non_blank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    blanked = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", r"\S", " ")).otherwise(F.col("text"))
    return filters.non_blank(docs.select("doc_id", blanked.alias("t")), "t").select("doc_id")


@query("flt_14_validate", """SELECT doc_id, array_to_string(list_filter([
    CASE WHEN query = '' THEN 'query_empty' END,
    CASE WHEN length(query) > 1000 THEN 'query_too_long' END,
    CASE WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k_out_of_range' END,
    CASE WHEN min_score NOT BETWEEN 0 AND 1 THEN 'min_score_out_of_range' END,
    CASE WHEN length(user_code) > 20000 THEN 'user_code_too_long' END,
    CASE WHEN start_line < 1 THEN 'start_line_below_one' END,
    CASE WHEN end_line < 1 THEN 'end_line_below_one' END,
    CASE WHEN end_line < start_line THEN 'line_range_inverted' END,
    CASE WHEN file_path IS NULL AND user_code = '' THEN 'no_review_target' END], lambda x: x IS NOT NULL), ' ') AS errors
  FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS query,
    doc_id % 60 AS top_k, (doc_id % 130) / 100.0 AS min_score,
    CASE WHEN doc_id % 8 = 0 THEN '' ELSE text END AS user_code,
    CASE WHEN doc_id % 3 = 0 THEN source END AS file_path,
    doc_id % 10 AS start_line, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS end_line FROM documents)""")
def validate(spark, sf_dir):
    i = F.col("doc_id")
    requests = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(i % 9 == 0, "").otherwise(F.col("text")).alias("query"),
        (i % 60).alias("top_k"),
        ((i % 130) / 100.0).alias("min_score"),
        F.when(i % 8 == 0, "").otherwise(F.col("text")).alias("user_code"),
        F.when(i % 3 == 0, F.col("source")).alias("file_path"),
        (i % 10).alias("start_line"),
        F.when(i % 2 == 0, i % 7).alias("end_line"),
    )
    return filters.validate_requests(requests).select("doc_id", F.array_join("errors", " ").alias("errors"))


# Pages give foreign addresses; a part of them is turned into repository ones.
_URL = """CASE page_id % 8 WHEN 0 THEN concat('https://GitHub.com:443/o', page_id, '/r.git/')
  WHEN 1 THEN concat(' https://github.com/o/', page_id, '  ') WHEN 2 THEN concat('https://github.com/', page_id)
  WHEN 3 THEN concat('https://github.com/a/b/', page_id) WHEN 4 THEN concat('http://github.com/a/', page_id)
  WHEN 5 THEN '   ' ELSE url END"""


@query("fn_12_normalize_url", f"""SELECT page_id,
  CASE page_id % 8 WHEN 0 THEN concat('https://github.com/o', page_id, '/r')
    WHEN 1 THEN concat('https://github.com/o/', page_id) END AS url,
  CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'too_few_segments'
    WHEN 3 THEN 'too_many_segments' WHEN 4 THEN 'scheme' WHEN 5 THEN 'empty'
    ELSE CASE WHEN starts_with(url, 'https:') THEN 'host' ELSE 'scheme' END END AS reason FROM pages""")
def normalize_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("u"))
    parsed = urls.normalize_repo_url(F.col("u"))
    return pages.select("page_id", parsed["url"].alias("url"), parsed["reason"].alias("reason"))


@query("fn_13_full_name", r"""SELECT page_id, CASE WHEN len(parts) >= 2
    THEN concat(parts[1], '/', regexp_replace(parts[2], '\.git$', '')) ELSE 'default' END AS full_name
  FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'),
    lambda x: x <> '') AS parts FROM pages)""")
def full_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.full_name(F.col("url"), F.lit("default")).alias("full_name")
    )


_SPAN = "CASE WHEN doc_id % 4 <> 0 THEN doc_id % 9 + 1 END", "CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 + 1 + doc_id % 2 END"


@query("fn_14_location", f"""{FILES} SELECT doc_id, {q.location(PATH, 'a', 'b')} AS location
  FROM (SELECT doc_id, path, {_SPAN[0]} AS a, {_SPAN[1]} AS b FROM files)""")
def location(spark, sf_dir):
    files = table(spark, sf_dir, "files")
    return files.select(
        "doc_id", tx.location(F.col("path"), F.expr(_SPAN[0]), F.expr(_SPAN[1])).alias("location")
    )


@query("fn_15_cosine", """SELECT a.vec_id, round(greatest(0, least(1,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


@query("fn_16_l2_normalize", """SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
    round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x /
      sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vx.l2_normalize(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(vx.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query("emb_3_check_dimension", """SELECT vec_id, len(v) = 64 AS good FROM (SELECT vec_id,
  CASE WHEN vec_id % 5 = 0 THEN embedding[1:32] ELSE embedding END AS v FROM embeddings)""")
def check_dimension(spark, sf_dir):
    from codelode.operators.embedding import check_dimension as check

    good, bad = check(_short_vectors(spark, sf_dir), 64)
    flag = lambda df, v: df.select("vec_id", F.lit(v).alias("good"))
    return flag(good, True).unionByName(flag(bad, False))


def _short_vectors(spark, sf_dir):
    vector = F.col("embedding")
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice(vector, 1, 32)).otherwise(vector)
    return table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("embedding"))


@query("emb_5_invalidate", "SELECT vec_id, vec_id % 5 <> 0 AS kept FROM embeddings")
def invalidate(spark, sf_dir):
    kept = vx.invalidate(F.col("embedding"), 64).isNotNull()
    return _short_vectors(spark, sf_dir).select("vec_id", kept.alias("kept"))


# ---- profiles --------------------------------------------------------------

CATALOG = f"""{FILES}, catalog AS (SELECT repository_id, path, {q.base(PATH)} AS name,
  {q.suffix(PATH)} AS extension, {q.language(PATH)} AS language, length AS size_bytes,
  {q.line_count(TEXT)} AS line_count FROM files
  WHERE NOT {q.ignored_dir(PATH)} AND ({q.verdict(PATH, 'length', 2097152)}) IS NULL)"""


def catalog(spark, sf_dir):
    return profile.scan_files(binary_tree(table(spark, sf_dir, "files")))


@query("agg_1_repository_totals", f"""{CATALOG} SELECT repository_id, count(*) AS file_count,
  CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(line_count) AS BIGINT) AS total_lines
  FROM catalog GROUP BY 1""")
def repository_totals(spark, sf_dir):
    return profile.repository_totals(catalog(spark, sf_dir))


LANGUAGES = f"""{CATALOG}, languages AS (SELECT repository_id, language, count(*) AS files,
  CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(line_count) AS BIGINT) AS lines
  FROM catalog WHERE language IS NOT NULL GROUP BY 1, 2)"""


@query("agg_2_language_stats", f"{LANGUAGES} SELECT * FROM languages")
def language_stats(spark, sf_dir):
    stats = profile.language_stats(profile.language_rows(catalog(spark, sf_dir)))
    rows = stats.select("repository_id", F.explode("language_stats").alias("language", "s"))
    return rows.select("repository_id", "language", "s.files", "s.bytes", "s.lines")


@query("agg_3_primary_language", f"""{LANGUAGES} SELECT repository_id, language AS primary_language FROM
  (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY bytes DESC, language) AS r FROM languages)
  WHERE r = 1""")
def primary_language(spark, sf_dir):
    return profile.primary_language(profile.language_rows(catalog(spark, sf_dir)))


@query("agg_4_directory_summary", f"""{CATALOG} SELECT repository_id, {q.top_dir(PATH)} AS directory,
  count(*) AS files FROM catalog GROUP BY 1, 2""")
def directory_summary(spark, sf_dir):
    return profile.directory_rows(catalog(spark, sf_dir))


MAX_FILES = 30


@query("agg_5_file_catalog", f"""{CATALOG} SELECT repository_id, row_number() OVER (PARTITION BY repository_id ORDER BY path) - 1 AS place,
    path, name, extension, language, size_bytes, line_count FROM catalog""")
def file_catalog(spark, sf_dir):
    return profile.file_catalog(catalog(spark, sf_dir)).select(
        "repository_id", "place", "path", "name", "extension", "language", "size_bytes", "line_count"
    )


@query("agg_6_ingest_limits", f"""{CATALOG} SELECT repository_id,
  CASE WHEN count(*) > {MAX_FILES} THEN 'Repository file count exceeds maximum limit of {MAX_FILES} files.'
    WHEN sum(size_bytes) > 60000 THEN 'Repository source size exceeds maximum limit of 60000 bytes.' END AS error_message
  FROM catalog GROUP BY 1""")
def ingest_limits(spark, sf_dir):
    totals = profile.repository_totals(catalog(spark, sf_dir))
    return profile.check_limits(totals, MAX_FILES, 60_000).select("repository_id", "error_message")


@query("run_1_profile", f"""{LANGUAGES}, t AS (SELECT repository_id, count(*) AS file_count,
    CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(line_count) AS BIGINT) AS total_lines,
    count(DISTINCT {q.top_dir(PATH)}) AS directories FROM catalog GROUP BY 1),
  p AS (SELECT repository_id, string_agg(concat(language, ':', files, ':', bytes, ':', lines), ',' ORDER BY language) AS languages,
    first(language ORDER BY bytes DESC, language) AS primary_language FROM languages GROUP BY 1)
  SELECT repository_id, 'completed' AS status, file_count, total_size_bytes, total_lines, primary_language,
    languages, directories, file_count AS listed FROM t LEFT JOIN p USING (repository_id)""")
def run_profile(spark, sf_dir):
    found = profile.profile_repository(catalog(spark, sf_dir))
    entry = lambda e: F.concat_ws(":", e.key, *[e.value[n].cast("string") for n in ("files", "bytes", "lines")])
    count = lambda df, name: df.groupBy("repository_id").agg(F.count(F.lit(1)).alias(name))
    runs = found.runs.select(
        "repository_id", "status", "file_count", "total_size_bytes", "total_lines", "primary_language",
        F.array_join(F.transform(F.map_entries("language_stats"), entry), ",").alias("languages"),
    )
    return runs.join(count(found.directories, "directories"), "repository_id").join(count(found.files, "listed"), "repository_id")
