"""Runs, repositories, sources, sinks, embeddings, streams (WIN-1, WIN-6, WIN-7, RUN, REP, JN-9 to
JN-11, SRC, SNK, EMB, STR)."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from checks import sqltext as q
from checks.corpus import table, with_tables
from checks.q_files import CATALOG
from checks.q_chunks import _KEPT, windows
from checks.registry import query
from codelode import fixed

from codelode.operators import embedding as emb, lifecycle, ranking

from codelode.plans.ingest import ingest, ingest_into
from codelode.session import shared_folder, store
from codelode.sources import archives as arc, metadata, sinks, trees
from codelode.sources.commits import CommitLog
from codelode.streaming.index_stream import index_stream, read_index
from codelode.streaming.status_stream import run_status_stream

RUNS = with_tables("runs")
NOW = "2026-01-01 00:00:00"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "runs")


def now():
    return F.lit(NOW).cast("timestamp")


@query("win_1_latest_run", RUNS + """ SELECT repository_id, id, status FROM (SELECT *, row_number() OVER
  (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS n FROM runs) WHERE n = 1""")
def win_1(spark, sf_dir):
    return ranking.latest_run(runs(spark, sf_dir), completed_only=False).select("repository_id", "id", "status")


@query("win_1_latest_completed", RUNS + """ SELECT repository_id, id FROM (SELECT *, row_number() OVER
  (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS n FROM runs WHERE status = 'completed') WHERE n = 1""")
def win_1_completed(spark, sf_dir):
    return ranking.latest_run(runs(spark, sf_dir)).select("repository_id", "id")


@query("win_6_recent_runs", RUNS + """ SELECT repository_id, id, rank, greatest(total - 5, 0) AS hidden_count FROM (SELECT *, row_number() OVER
  (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY repository_id) AS total FROM runs) WHERE rank <= 5""")
def win_6(spark, sf_dir):
    return ranking.recent_runs(runs(spark, sf_dir)).select("repository_id", "id", "rank", "hidden_count")


# ---- packing and spending -------------------------------------------------------


@query("running_position", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position,
  CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents""")
def running_position(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    placed = ranking.position(docs, ["source"], ["doc_id"])
    return ranking.running_total(placed, ["source"], ["doc_id"], F.col("n_chars"), "before").drop("n_chars")


# Packing restarts from a text count and a token sum; a recursive walk over each
# slice says the same as the fold.
@query("win_7_pack_batches", """WITH RECURSIVE placed AS (SELECT source, doc_id,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position,
    greatest(1, CAST(floor(length(text) / 3.5) AS BIGINT) + 1) AS tokens FROM documents),
  walk AS (SELECT source, position // 64 AS slice, position, tokens AS used, 1 AS texts, 0 AS batch
      FROM placed WHERE position % 64 = 0
    UNION ALL SELECT w.source, w.slice, p.position,
      CASE WHEN w.used + p.tokens > 2000 OR w.texts >= 5 THEN p.tokens ELSE w.used + p.tokens END,
      CASE WHEN w.used + p.tokens > 2000 OR w.texts >= 5 THEN 1 ELSE w.texts + 1 END,
      CASE WHEN w.used + p.tokens > 2000 OR w.texts >= 5 THEN w.batch + 1 ELSE w.batch END
    FROM walk w JOIN placed p ON p.source = w.source AND p.position = w.position + 1 AND p.position % 64 <> 0)
  SELECT source, position, slice, batch FROM walk""")
def win_7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = emb.batch_texts(docs, ["source"], ["doc_id"], "text", most_texts=5, most_tokens=2000)
    return packed.select("source", "position", "slice", "batch")


@query("emb_4_spend_guard", """SELECT source, doc_id, before < 20000 AS allowed FROM (SELECT source, doc_id,
  coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)""")
def emb_4(spark, sf_dir):
    batches = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return emb.spend_guard(batches, ["source"], ["doc_id"], "n_chars", 20_000).select("source", "doc_id", "allowed")


@query("emb_1_embed")
def emb_1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = emb.embed(docs, "text", emb.hash_embedding(32))
    return rows.select("doc_id", F.size("embedding").alias("width"), F.round(F.col("embedding")[0], 5).alias("first"))


_COORDINATES = """SELECT doc_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM (
  SELECT doc_id, i, CAST('0x' || md5(concat(i, ':', sha256(text)))[1:8] AS BIGINT) / 2147483648.0::DOUBLE - 1 AS x
  FROM documents, unnest(range(16)) AS r(i))"""


@query("emb_2_hash_embedding", f"SELECT doc_id, CAST(i AS INTEGER) AS i, x FROM ({_COORDINATES})")
def emb_2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(emb.hash_coordinates(F.col("text"), 16)).alias("i", "x")).withColumn("x", F.round("x", 6))


# ---- sources ---------------------------------------------------------------------

PER_ARCHIVE = 25
_ARCHIVE = T.StructType([T.StructField("archive", T.StringType()), T.StructField("content", T.BinaryType())])


def _tar(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["doc_id"])
    number = rows[0]["archive_id"]
    root = f"own-repo-{number:07x}/" if number % 2 == 0 else ""
    payload = io.BytesIO()
    with tarfile.open(fileobj=payload, mode="w:gz") as tar:
        for r in rows:
            name = f"../{r['path']}" if number % 5 == 1 and r is rows[-1] else f"{root}{r['path']}"
            data = r["text"].encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    content = payload.getvalue()[:40] if number % 7 == 3 else payload.getvalue()
    return pa.table({"archive": [str(number)], "content": [content]})


def archives(spark, sf_dir):
    """Documents packed 25 to an archive, some with an escaping entry, some cut short."""
    files = table(spark, sf_dir, "files").withColumn("archive_id", F.floor(F.col("doc_id") / PER_ARCHIVE))
    return files.select("archive_id", "doc_id", "path", "text").groupBy("archive_id").applyInArrow(_tar, _ARCHIVE)


_A = f"{with_tables('files')}, a AS (SELECT *, CAST(floor(doc_id / {PER_ARCHIVE}) AS BIGINT) AS n FROM files)"


@query("src_1_read_archives", f"""{_A} SELECT CAST(n AS VARCHAR) AS archive, path, length, sha256(text) AS content FROM a
  WHERE n % 5 <> 1 AND n % 7 <> 3""")
def src_1(spark, sf_dir):
    files, _errors = arc.expand_archives(archives(spark, sf_dir))
    return files.select("archive", "path", "length", F.sha2("content", 256).alias("content"))


@query("src_1_rejected", f"""{_A} SELECT DISTINCT CAST(n AS VARCHAR) AS archive,
  CASE WHEN n % 7 = 3 THEN 'corrupt' ELSE 'path_traversal' END AS error_class FROM a WHERE n % 5 = 1 OR n % 7 = 3""")
def src_1_rejected(spark, sf_dir):
    _files, errors = arc.expand_archives(archives(spark, sf_dir))
    return errors.select("archive", "error_class")


@query("src_2_source_tree", with_tables("files") + """ SELECT concat(repository_id, '/', doc_id, '.txt') AS path, length, sha256(text) AS content FROM files""")
def src_2(spark, sf_dir):
    """Every document as a file below its repository's folder, read back as a tree."""
    root = _folder(spark, "tree")
    docs = table(spark, sf_dir, "files").select("repository_id", "doc_id", F.col("text").cast("binary").alias("content"))
    trees.write_source_tree(docs.select(F.concat("repository_id", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "content"), root)
    return trees.read_source_tree(spark, root).select("path", "length", F.sha2("content", 256).alias("content"))


_META = """to_json(struct(CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS id,
  struct(concat('o', doc_id) AS login, 1 AS x) AS owner, source AS name, concat('o', doc_id, '/', source) AS full_name,
  text AS description, 'main' AS default_branch, CASE WHEN doc_id % 2 = 0 THEN lang END AS language,
  CASE WHEN doc_id % 3 = 0 THEN n_chars END AS stargazers_count, '2024-05-01T10:00:00Z' AS updated_at))"""


def metadata_rows(spark, sf_dir):
    text = f"CASE WHEN doc_id % 7 = 0 THEN concat('{{{{', doc_id) ELSE {_META} END"
    return spark.sql(f"SELECT doc_id AS id, {text} AS body FROM {{d}}", d=table(spark, sf_dir, "documents"))


_PARSED = """SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'malformed' WHEN doc_id % 5 = 0 THEN 'missing_field' END AS error,
  CASE WHEN doc_id % 35 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN true ELSE false END AS ok, * EXCLUDE (doc_id) FROM documents"""


@query("src_3_repo_metadata", f"""SELECT id, error, CASE WHEN ok THEN concat('o', id) END AS owner_login, CASE WHEN ok THEN source END AS name,
  CASE WHEN ok THEN text END AS description, CASE WHEN ok AND id % 2 = 0 THEN lang END AS language,
  CASE WHEN ok THEN CAST(CASE WHEN id % 3 = 0 THEN n_chars ELSE 0 END AS INT) END AS stargazers_count,
  CASE WHEN ok THEN 0 END AS forks_count FROM ({_PARSED})""")
def src_3(spark, sf_dir):
    rows = metadata.parse_repo_metadata(metadata_rows(spark, sf_dir), "body")
    return rows.select("id", "error", "owner_login", "name", "description", "language", "stargazers_count", "forks_count")


@query("src_4_archive_root", f"""{_A} SELECT DISTINCT CAST(n AS VARCHAR) AS archive, lower(printf('%07x', n)) AS commit_sha FROM a
  WHERE n % 5 <> 1 AND n % 7 <> 3 AND n % 2 = 0""")
def src_4(spark, sf_dir):
    files, _errors = arc.expand_archives(archives(spark, sf_dir))
    return files.where(F.col("commit_sha").isNotNull()).select("archive", "commit_sha").distinct()


# ---- sinks -----------------------------------------------------------------------


def _folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("snk_1_replace_chunks", """SELECT source AS repository_id, doc_id, CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 2 ELSE 1 END AS ingestion_id
  FROM documents WHERE CAST(substr(source, 4) AS INT) % 2 = 1 OR doc_id % 3 = 0""")
def snk_1(spark, sf_dir):
    target = _folder(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), "doc_id")
    sinks.replace_chunks(docs.withColumn("ingestion_id", F.lit(1)), target)
    even = F.substring("repository_id", 4, 9).cast("int") % 2 == 0
    again = docs.where(even & (F.col("doc_id") % 3 == 0)).withColumn("ingestion_id", F.lit(2))
    sinks.replace_chunks(again, target)
    return spark.read.parquet(target).select(F.col("repository_id").cast("string"), "doc_id", "ingestion_id")


@query("snk_2_run_log", """SELECT user_id AS id, status, event_id AS version FROM (SELECT user_id, event_type AS status, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def snk_2(spark, sf_dir):
    target = _folder(spark, "runs")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("version")
    )
    sinks.append_rows(log.where(F.col("version") % 2 == 0), target)
    sinks.append_rows(log.where(F.col("version") % 2 == 1), target)
    return sinks.current_runs(spark, target, "version").select("id", "status", "version")


@query("snk_4_cascade_delete", with_tables("runs", "files", "messages") + """, dead AS (SELECT DISTINCT repository_id FROM runs WHERE status = 'failed' AND id % 50 = 0)
  SELECT 'runs' AS name, count(*) AS left_over FROM runs WHERE repository_id NOT IN (SELECT repository_id FROM dead)
  UNION ALL SELECT 'chunks', count(*) FROM files WHERE repository_id NOT IN (SELECT repository_id FROM dead)
  UNION ALL SELECT 'messages', count(*) FROM messages WHERE concat('src', conversation_id % 20) NOT IN (SELECT repository_id FROM dead)""")
def snk_4(spark, sf_dir):
    log = runs(spark, sf_dir)
    ids = log.where((F.col("status") == "failed") & (F.col("id") % 50 == 0)).select("repository_id")
    messages = table(spark, sf_dir, "messages")
    talks = messages.select(
        F.col("conversation_id").alias("id"), F.concat(F.lit("src"), F.col("conversation_id") % 20).alias("repository_id")
    ).distinct()
    repositories = log.select(F.col("repository_id").alias("id")).distinct()
    kept = sinks.cascade_delete(ids, repositories, log, table(spark, sf_dir, "files"), talks, messages)
    out = None
    for name in ("runs", "chunks", "messages"):
        rows = kept[name].agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(name).alias("name"), "left_over")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- repositories and sweeps -----------------------------------------------------

_NEW_URL = """CASE page_id % 4 WHEN 0 THEN concat('https://github.com/o', page_id % 40, '/r.git')
  WHEN 1 THEN concat('https://github.com/o', page_id % 40, '/r/') WHEN 2 THEN concat('https://github.com/p/', page_id) ELSE url END"""
_CANON = """CASE page_id % 4 WHEN 2 THEN concat('https://github.com/p/', page_id)
  WHEN 3 THEN NULL ELSE concat('https://github.com/o', page_id % 40, '/r') END"""
_REG = f"""WITH known AS (SELECT DISTINCT doc_id % 5 AS owner_id, concat('https://github.com/o', doc_id % 20, '/r') AS github_url FROM documents),
  new AS (SELECT page_id AS request_id, page_id % 5 AS owner_id, {_CANON} AS github_url, url FROM pages),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY owner_id, github_url ORDER BY request_id) AS n FROM new WHERE github_url IS NOT NULL),
  good AS (SELECT * FROM numbered WHERE n = 1 AND NOT EXISTS
    (SELECT 1 FROM known k WHERE k.owner_id = numbered.owner_id AND k.github_url = numbered.github_url))"""


def _register(spark, sf_dir):
    i = F.col("doc_id")
    known = table(spark, sf_dir, "documents").select(
        (i % 5).alias("owner_id"), F.concat(F.lit("https://github.com/o"), i % 20, F.lit("/r")).alias("github_url")
    )
    p = F.col("page_id")
    new = table(spark, sf_dir, "pages").select(
        p.alias("request_id"), (p % 5).alias("owner_id"), F.lit("n").alias("name"), F.expr(_NEW_URL).alias("github_url")
    )
    return lifecycle.register(known, new)


@query("rep_1_register", f"""{_REG} SELECT request_id, owner_id, github_url, replace(github_url, 'https://github.com/', '') AS full_name,
  'pending' AS status FROM good""")
def rep_1(spark, sf_dir):
    accepted, _rejected = _register(spark, sf_dir)
    return accepted.select("request_id", "owner_id", "github_url", "full_name", "status")


@query("jn_9_already_registered", f"""{_REG} SELECT request_id, CASE WHEN github_url IS NOT NULL THEN 'already_registered'
    WHEN starts_with(url, 'https:') THEN 'host' ELSE 'scheme' END AS reason
  FROM new WHERE request_id NOT IN (SELECT request_id FROM good)""")
def jn_9(spark, sf_dir):
    _accepted, rejected = _register(spark, sf_dir)
    return rejected.select("request_id", "reason")


def _repositories(spark, sf_dir):
    return spark.sql(
        """SELECT doc_id AS id, CAST(NULL AS BIGINT) AS github_repository_id, CAST(NULL AS STRING) AS github_owner, 'old' AS name,
      'x/old' AS full_name, concat('https://github.com/x/', doc_id, '.git') AS github_url, 'd' AS description, 'C' AS primary_language,
      'analyzing' AS status, CAST(NULL AS STRING) AS default_branch, 1 AS stars, 2 AS forks, 3 AS open_issues,
      CAST(NULL AS TIMESTAMP) AS github_updated_at, CAST(NULL AS TIMESTAMP) AS last_synced_at FROM {d}""",
        d=table(spark, sf_dir, "documents"),
    )


@query("rep_2_sync", f"""SELECT id, CASE WHEN id % 11 = 0 THEN 'analyzing' WHEN ok THEN 'ready' ELSE 'failed' END AS status,
  CASE WHEN ok AND id % 11 <> 0 THEN source ELSE 'old' END AS name,
  CASE WHEN ok AND id % 11 <> 0 THEN CASE WHEN id % 2 = 0 THEN lang END ELSE 'C' END AS primary_language,
  CASE WHEN ok AND id % 11 <> 0 THEN CAST(CASE WHEN id % 3 = 0 THEN n_chars ELSE 0 END AS INT) ELSE 1 END AS stars,
  CASE WHEN ok AND id % 11 <> 0 THEN concat('https://github.com/x/', id) ELSE concat('https://github.com/x/', id, '.git') END AS github_url,
  ok AND id % 11 <> 0 AS synced FROM ({_PARSED})""")
def rep_2(spark, sf_dir):
    fetched = metadata.parse_repo_metadata(metadata_rows(spark, sf_dir), "body").where(F.col("id") % 11 != 0)
    rows = lifecycle.sync(_repositories(spark, sf_dir), fetched, now())
    return rows.select(
        "id", "status", "name", "primary_language", "stars", "github_url",
        F.col("last_synced_at").isNotNull().alias("synced"),
    )


@query("jn_10_sync_failures", f"SELECT id, error FROM ({_PARSED}) WHERE id % 11 <> 0 AND error IS NOT NULL")
def jn_10(spark, sf_dir):
    fetched = metadata.parse_repo_metadata(metadata_rows(spark, sf_dir), "body").where(F.col("id") % 11 != 0)
    rows = lifecycle.sync(_repositories(spark, sf_dir), fetched, now()).where(F.col("status") == "failed")
    return rows.join(fetched.select("id", "error"), "id").select("id", "error")


@query("rep_3_patch", """SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.source END AS name,
  CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS description FROM documents d LEFT JOIN labels l USING (doc_id)""")
def rep_3(spark, sf_dir):
    repos = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("description")
    )
    updates = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").alias("name"),
        F.when(F.col("toxic") == 1, "toxic").alias("description"),
    )
    return lifecycle.patch(repos, updates)


_REPO_STATUS = "CASE CAST(substr(repository_id, 4) AS INT) % 3 WHEN 0 THEN 'analyzing' WHEN 1 THEN 'ready' ELSE 'pending' END"


def _status_repositories(spark, sf_dir):
    ids = runs(spark, sf_dir).select("repository_id").distinct()
    return ids.select(F.col("repository_id").alias("id"), F.expr(_REPO_STATUS).alias("status"))


@query("run_3_sweep_runs", RUNS + f""" SELECT id, CASE WHEN status = 'ingesting' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'ingesting' THEN '{fixed.MSG_SWEPT}' ELSE error_message END AS error_message FROM runs""")
def run_3(spark, sf_dir):
    return lifecycle.sweep_runs(runs(spark, sf_dir), now()).select("id", "status", "error_message")


@query("run_3_sweep_repositories", RUNS + f""" SELECT repository_id AS id, CASE WHEN {_REPO_STATUS} = 'analyzing' AND repository_id IN
    (SELECT repository_id FROM runs WHERE status = 'ingesting' OR error_message = '{fixed.MSG_SWEPT}') THEN 'failed' ELSE {_REPO_STATUS} END AS status
  FROM (SELECT DISTINCT repository_id FROM runs)""")
def run_3_repositories(spark, sf_dir):
    swept = lifecycle.sweep_runs(runs(spark, sf_dir), now())
    return lifecycle.sweep_repositories(_status_repositories(spark, sf_dir), swept)


@query("agg_11_sweep_count", RUNS + " SELECT count(*) AS swept_count FROM runs WHERE status = 'ingesting'")
def agg_11(spark, sf_dir):
    return lifecycle.sweep_count(lifecycle.sweep_runs(runs(spark, sf_dir), now()))


@query("jn_11_restart_failed", RUNS + f""" SELECT DISTINCT repository_id AS id FROM runs WHERE status = 'failed'
  AND error_message = '{fixed.MSG_SWEPT}'""")
def jn_11(spark, sf_dir):
    return lifecycle.restart_failed(_status_repositories(spark, sf_dir), runs(spark, sf_dir)).select("id")


# ---- ingest and streams ------------------------------------------------------------


def _ingested(spark, sf_dir):
    rows = archives(spark, sf_dir).select(
        F.col("archive").alias("repository_id"), F.lit(1).alias("ingestion_id"), "content"
    )
    return ingest(rows, None, now())


_RUN2 = CATALOG.replace("repository_id, path,", f"CAST(floor(doc_id / {PER_ARCHIVE}) AS BIGINT) AS n, path,", 1)


@query("run_2_ingest", f"""{_RUN2}, ids AS (SELECT DISTINCT CAST(floor(doc_id / {PER_ARCHIVE}) AS BIGINT) AS n FROM documents),
  t AS (SELECT n, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM catalog GROUP BY 1)
  SELECT CAST(n AS VARCHAR) AS repository_id, CASE WHEN n % 5 = 1 OR n % 7 = 3 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN n % 2 = 0 AND n % 5 <> 1 AND n % 7 <> 3 THEN printf('%07x', n) END AS commit_sha,
    CASE WHEN n % 5 <> 1 AND n % 7 <> 3 THEN coalesce(files, 0) END AS file_count,
    CASE WHEN n % 5 <> 1 AND n % 7 <> 3 THEN coalesce(lines, 0) END AS total_lines FROM ids LEFT JOIN t USING (n)""")
def run_2(spark, sf_dir):
    return _ingested(spark, sf_dir).runs.select("repository_id", "status", "commit_sha", "file_count", "total_lines")


@query("run_2_ingest_chunks", f"""{_A}, kept AS (SELECT * FROM a WHERE {_KEPT} AND n % 5 <> 1 AND n % 7 <> 3),
  w AS ({windows('kept', 'path', 50, 10)}) SELECT path AS file_path, start_line, end_line, sha256({q.strip('chunk_text')}) AS content_hash FROM w""")
def run_2_chunks(spark, sf_dir):
    return _ingested(spark, sf_dir).chunks.select("file_path", "start_line", "end_line", "content_hash")


def _committed(spark, sf_dir):
    """Every archive as run 1, those of even repositories again as run 2, and a third of the repositories deleted."""
    log = CommitLog(spark, _folder(spark, "store"))
    rows = archives(spark, sf_dir).select(F.col("archive").alias("repository_id"), F.lit(1).alias("ingestion_id"), "content")
    rows = store(rows, "archives")
    number = F.col("repository_id").cast("int")
    ingest_into(log, rows, None, now())
    ingest_into(log, rows.where(number % 2 == 0).withColumn("ingestion_id", F.lit(2)), None, now())
    log.commit({}, gone=rows.where(number % 3 == 0).select("repository_id"))
    return log


@query("run_2_committed_chunks", f"""{_A}, kept AS (SELECT * FROM a WHERE {_KEPT} AND n % 5 <> 1 AND n % 7 <> 3 AND n % 3 <> 0),
  w AS ({windows('kept', 'path', 50, 10)}) SELECT CAST(n AS VARCHAR) AS repository_id, CAST(2 - n % 2 AS INT) AS ingestion_id, path AS file_path,
    start_line, end_line, sha256({q.strip('chunk_text')}) AS content_hash FROM w JOIN (SELECT path, n FROM a) USING (path)""")
def run_2_committed_chunks(spark, sf_dir):
    return _committed(spark, sf_dir).current("chunks").select("repository_id", "ingestion_id", "file_path", "start_line", "end_line", "content_hash")


@query("run_2_committed_status", f"""{_A}, ids AS (SELECT DISTINCT n FROM a WHERE n % 3 <> 0)
  SELECT CAST(n AS VARCHAR) AS repository_id, CASE WHEN n % 5 = 1 OR n % 7 = 3 THEN 'failed' ELSE 'ready' END AS status FROM ids""")
def run_2_committed_status(spark, sf_dir):
    log = _committed(spark, sf_dir)
    log.compact()
    return log.current("repository_status").select("repository_id", "status")


_DEAD = "(SELECT repository_id FROM runs WHERE status = 'failed' AND id % 50 = 0)"


@query("snk_4_tombstones", with_tables("runs", "files", "messages") + f""" SELECT 'repositories' AS name, repository_id AS key FROM runs WHERE repository_id NOT IN {_DEAD}
  GROUP BY repository_id UNION ALL SELECT 'runs', CAST(id AS VARCHAR) FROM runs WHERE repository_id NOT IN {_DEAD}
  UNION ALL SELECT 'chunks', CAST(doc_id AS VARCHAR) FROM files WHERE repository_id NOT IN {_DEAD}
  UNION ALL SELECT 'conversations', CAST(conversation_id AS VARCHAR) FROM messages WHERE concat('src', conversation_id % 20) NOT IN {_DEAD} GROUP BY conversation_id
  UNION ALL SELECT 'messages', CAST(id AS VARCHAR) FROM messages WHERE concat('src', conversation_id % 20) NOT IN {_DEAD}""")
def snk_4_tombstones(spark, sf_dir):
    """The cascade over all five tables of the store, row by row."""
    log, past = CommitLog(spark, _folder(spark, "store")), runs(spark, sf_dir)
    messages = table(spark, sf_dir, "messages")
    owner = F.concat(F.lit("src"), F.col("conversation_id") % 20).alias("repository_id")
    log.commit({
        "repositories": past.select(F.col("repository_id").alias("id")).distinct(),
        "runs": past,
        "chunks": table(spark, sf_dir, "files").select("repository_id", F.col("doc_id").alias("id")),
        "conversations": messages.select(F.col("conversation_id").alias("id"), owner).distinct(),
        "messages": messages.select("id", "conversation_id"),
    })
    log.commit({}, gone=past.where((F.col("status") == "failed") & (F.col("id") % 50 == 0)).select("repository_id"))
    out = None
    for name in ("repositories", "runs", "chunks", "conversations", "messages"):
        rows = log.current(name).select(F.lit(name).alias("name"), F.col("id").cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("str_1_index_stream", f"""{with_tables('files')}, w AS ({windows('files', 'path', 50, 10)}) SELECT path AS file_path, start_line, end_line FROM w""")
def str_1(spark, sf_dir):
    source, target, state = (_folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    files = table(spark, sf_dir, "files").select(
        "repository_id", F.lit(2).alias("ingestion_id"), F.col("path").alias("file_path"),
        F.lit(None).cast("string").alias("language"), "text",
    )
    # An older run that goes, then every repository's files in four batches, the last seen once more. A batch has as many
    # files as there are cores: a file of one row group goes to one task.
    cores = spark.sparkContext.defaultParallelism
    files.where("length < 2000").withColumn("ingestion_id", F.lit(1)).repartition(cores).write.parquet(source)
    files.repartition(4 * cores).write.mode("append").parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", cores).parquet(source)
    index_stream(stream, target, state).awaitTermination()
    index_stream(stream, target, state + "-again").awaitTermination()
    return read_index(spark, target).select("file_path", "start_line", "end_line")


_STATUS_SQL = RUNS + """ SELECT repository_id, status, status IN ('completed', 'failed') AS terminal FROM (SELECT *, row_number() OVER
  (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS n FROM runs) WHERE n = 1"""


@query("str_2_run_status", _STATUS_SQL)
def str_2(spark, sf_dir):
    return run_status_stream(runs(spark, sf_dir)).select("repository_id", "status", "terminal")


@query("str_2_run_status_stream", _STATUS_SQL)
def str_2_stream(spark, sf_dir):
    import uuid

    source, state, target = (_folder(spark, n) for n in ("status-in", "status-state", "status-out"))
    log = runs(spark, sf_dir)
    log.write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)

    def write(batch, _batch_id):
        # Complete mode hands over one row per repository each time.
        batch.write.mode("overwrite").parquet(target)

    (
        run_status_stream(stream).writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", state).queryName(f"status_{uuid.uuid4().hex}")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(target).select("repository_id", "status", "terminal")
