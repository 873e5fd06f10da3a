"""Contexts, reviews and conversations (CTX, REV, CNV, FN-18 to FN-22, WIN-2, WIN-3, WIN-5, SNK-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as q
from checks.corpus import table, with_tables
from checks.registry import query
from codelode import fixed
from codelode.functions import text as tx
from codelode.operators import conversations as conv, evidence as ev, ranking, review
from codelode.plans import assist

SYSTEM = "Answer from the evidence only."
BUDGET = 2_000
_SYS = len(SYSTEM)

RESULTS = with_tables("results", "questions", "messages")
BEST = RESULTS + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC) AS n
  FROM results WHERE score >= 0.11 AND regexp_matches(chunk_text, '\\S')) WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS evidence_rank FROM best),
blocks AS (SELECT r.*, s.question, concat('[Source ', evidence_rank, ': ', file_path, ':', start_line, '-', end_line,
    CASE WHEN language IS NULL THEN '' ELSE concat(', language=', language) END,
    CASE WHEN name IS NULL THEN '' ELSE concat(', symbol=', name) END,
    ', score=', printf('%.2f', score), ']', chr(10), chunk_text) AS block
  FROM ranked r JOIN questions s USING (query_id))"""
BASE = (
    f"(CAST(ceil({_SYS} / 4.0) AS BIGINT) + 4 + "
    "CAST(ceil((length('Repository evidence:') + 7 + length('Question: ') + length(question) + 2) / 4.0) AS BIGINT))"
)
FITTED = BEST + f""",
costed AS (SELECT *, {BASE} + sum(CAST(ceil(length(block) / 4.0) AS BIGINT)) OVER
  (PARTITION BY query_id ORDER BY evidence_rank) AS tokens_after FROM blocks),
fitted AS (SELECT * FROM costed WHERE tokens_after <= {BUDGET})"""
STATUS = FITTED + f""",
state AS (SELECT s.query_id, s.question, s.conversation_id, s.requires_evidence, {BASE} AS base,
    (SELECT count(*) FROM ranked r WHERE r.query_id = s.query_id) AS qualifying,
    (SELECT count(*) FROM fitted f WHERE f.query_id = s.query_id) AS fitted,
    (SELECT max(tokens_after) FROM fitted f WHERE f.query_id = s.query_id) AS spent FROM questions s),
status AS (SELECT *, coalesce(CAST(spent AS BIGINT), base) AS used, CASE WHEN requires_evidence AND qualifying = 0 THEN 'insufficient_evidence'
    WHEN base > {BUDGET} THEN 'context_overflow' WHEN requires_evidence AND fitted = 0 THEN 'insufficient_evidence'
    ELSE 'ready' END AS status FROM state),
recent AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS recency FROM messages),
past AS (SELECT * FROM (SELECT s.query_id, r.recency, r.role, r.content, s.used + sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4)
      OVER (PARTITION BY s.query_id ORDER BY recency) AS tokens_after
    FROM status s JOIN recent r USING (conversation_id) WHERE r.recency <= 8 AND s.status = 'ready')
  WHERE tokens_after <= {BUDGET})"""


def results(spark, sf_dir):
    return table(spark, sf_dir, "results")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "questions")


def messages(spark, sf_dir):
    return table(spark, sf_dir, "messages")


@query("agg_12_best_per_chunk", RESULTS + " SELECT query_id, chunk_id, max(score) AS score FROM results GROUP BY 1, 2")
def agg_12(spark, sf_dir):
    return ev.best_per_chunk(results(spark, sf_dir)).select("query_id", "chunk_id", "score")


@query("ctx_1_select_evidence", BEST + " SELECT query_id, chunk_id, evidence_rank, score FROM ranked")
def ctx_1(spark, sf_dir):
    return ev.select_evidence(results(spark, sf_dir)).select("query_id", "chunk_id", "evidence_rank", "score")


@query("win_5_evidence_rank", BEST + " SELECT query_id, max(evidence_rank) AS ranks, min(score) AS lowest FROM ranked GROUP BY 1")
def win_5(spark, sf_dir):
    return ev.select_evidence(results(spark, sf_dir)).groupBy("query_id").agg(
        F.max("evidence_rank").alias("ranks"), F.min("score").alias("lowest")
    )


@query("fn_18_evidence_block", BEST + " SELECT query_id, evidence_rank, sha256(block) AS block FROM blocks")
def fn_18(spark, sf_dir):
    rows = ev.select_evidence(results(spark, sf_dir))
    block = tx.evidence_block(F.col("evidence_rank"), {c: F.col(c) for c in ev.CHUNK_COLUMNS})
    return rows.select("query_id", "evidence_rank", F.sha2(block, 256).alias("block"))


@query("ctx_2_fit_evidence", FITTED + " SELECT query_id, evidence_rank, CAST(tokens_after AS BIGINT) AS tokens_after FROM fitted")
def ctx_2(spark, sf_dir):
    rows = ev.select_evidence(results(spark, sf_dir))
    return ev.fit_evidence(rows, questions(spark, sf_dir), SYSTEM, BUDGET).select(
        "query_id", "evidence_rank", "tokens_after"
    )


@query("win_2_recent_messages", RESULTS + """ SELECT id, recency FROM (SELECT id, 1 + conversation_id % 6 AS n, row_number() OVER
  (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS recency FROM messages) WHERE recency <= n""")
def win_2(spark, sf_dir):
    rows = ranking.recent_messages(messages(spark, sf_dir), 6, 1 + F.col("conversation_id") % 6)
    return rows.select("id", "recency")


@query("win_3_budget_prefix", """SELECT doc_id, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, 10 + sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4)
  OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 12000""")
def win_3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = ranking.budget_prefix(
        docs, ["source"], [F.col("doc_id")], tx.message_tokens(F.col("text")), F.lit(10),
        fixed.TOKEN_BUDGET, fixed.MESSAGE_OVERHEAD_TOKENS,
    )
    return kept.select("doc_id", F.col("tokens_after").alias("used"))


@query("ctx_3_fit_history", RESULTS + """, recent AS (SELECT *, row_number() OVER (PARTITION BY conversation_id
    ORDER BY created_at DESC, id DESC) AS recency FROM messages)
  SELECT query_id, id, CAST(used AS BIGINT) AS used FROM (SELECT conversation_id * 10 AS query_id, id, 11000 + (conversation_id * 37) % 900 +
    sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4) OVER (PARTITION BY conversation_id ORDER BY recency) AS used
    FROM recent WHERE recency <= 8) WHERE used <= 12000""")
def ctx_3(spark, sf_dir):
    rows = messages(spark, sf_dir)
    c = F.col("conversation_id")
    used = rows.select(
        "conversation_id", (c * 10).alias("query_id"), (F.lit(11000) + (c * 37) % 900).alias("tokens_used")
    ).distinct()
    return ev.fit_history(rows, used).select("query_id", "id", F.col("tokens_after").alias("used"))


def _context(spark, sf_dir):
    return ev.build_context(
        results(spark, sf_dir), questions(spark, sf_dir), messages(spark, sf_dir), SYSTEM, budget=BUDGET
    )


@query("ctx_4_build_context", STATUS + """,
  joined AS (SELECT query_id, string_agg(block, concat(chr(10), chr(10)) ORDER BY evidence_rank) AS blocks FROM fitted GROUP BY 1),
  said AS (SELECT query_id, count(*) AS n, max(tokens_after) AS tokens, string_agg(concat(role, ':', content), '|' ORDER BY recency DESC) AS t FROM past GROUP BY 1)
  SELECT s.query_id, CAST(coalesce(d.tokens, s.used) AS BIGINT) AS tokens_used, CAST(2 + coalesce(d.n, 0) AS INT) AS n_messages,
    sha256(CASE WHEN s.fitted > 0 THEN concat('Repository evidence:', chr(10), chr(10), j.blocks, chr(10), chr(10), '---', chr(10), chr(10), 'Question: ', s.question)
      ELSE concat('Question: ', s.question) END) AS user_turn, coalesce(sha256(d.t), '') AS past
  FROM status s LEFT JOIN joined j USING (query_id) LEFT JOIN said d USING (query_id) WHERE s.status = 'ready'""")
def ctx_4(spark, sf_dir):
    rows = _context(spark, sf_dir).where(F.col("status") == "ready")
    m = F.col("messages")
    middle = F.slice(m, 2, F.size(m) - 2)
    past = F.array_join(F.transform(middle, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return rows.select(
        "query_id",
        "tokens_used",
        F.size("messages").alias("n_messages"),
        F.sha2(F.element_at("messages", -1)["content"], 256).alias("user_turn"),
        F.when(F.size(m) > 2, F.sha2(past, 256)).otherwise("").alias("past"),
    )


@query("ctx_5_status", STATUS + " SELECT query_id, status, qualifying FROM status")
def ctx_5(spark, sf_dir):
    return _context(spark, sf_dir).select("query_id", "status", "qualifying")


@query("agg_10_token_totals", RESULTS + """ SELECT conversation_id, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4) AS BIGINT) AS tokens
  FROM messages GROUP BY 1""")
def agg_10(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("conversation_id").agg(
        F.sum(tx.message_tokens(F.col("content"))).alias("tokens")
    )


# ---- requests -----------------------------------------------------------------

_TARGETS = """SELECT doc_id AS query_id, source AS repository_id, {path} AS file_path,
  CASE WHEN doc_id % 3 = 0 THEN concat('sym_', doc_id) WHEN doc_id % 3 = 1 THEN '' END AS symbol,
  CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 9 + 1 AS INT) END AS start_line,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 9 + 1 + doc_id % 2 AS INT) END AS end_line,
  CASE WHEN doc_id % 2 = 0 THEN left(text, 900) END AS question,
  CASE WHEN doc_id % 8 IN (0, 1) THEN concat('  ', chr(10), ' ', left(text, 300)) END AS user_code,
  CASE doc_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'bugs' ELSE 'security' END AS focus FROM {src}"""
TARGETS = with_tables("files") + ", t AS (" + _TARGETS.format(
    path="CASE WHEN doc_id % 8 = 0 THEN NULL ELSE path END", src="(SELECT *, repository_id AS source FROM files)") + ")"
_SYMBOL = "CASE WHEN symbol <> '' THEN symbol END"
_TARGET = f"concat({q.location('file_path', 'start_line', 'end_line')}, CASE WHEN symbol <> '' THEN concat(' (symbol: ', symbol, ')') ELSE '' END)"


def targets(spark, sf_dir):
    body = _TARGETS.format(path="CASE WHEN doc_id % 8 = 0 THEN NULL ELSE path END",
                           src="(SELECT *, repository_id AS source FROM {files})")
    return spark.sql(body, files=table(spark, sf_dir, "files"))


@query("ctx_6_ask_requests", with_tables("requests") + """ SELECT query_id, query, query AS question, 'hybrid' AS mode,
  10 AS top_k, true AS requires_evidence FROM requests""")
def ask(spark, sf_dir):
    rows = table(spark, sf_dir, "requests").withColumnRenamed("query", "message")
    return assist.ask_requests(rows).select("query_id", "query", "question", "mode", "top_k", "requires_evidence")


_EXPLAIN = f"""{TARGETS} SELECT query_id, left(coalesce({_SYMBOL}, nullif(question, ''), nullif({q.stem('file_path')}, ''), file_path), 1000) AS query,
  concat('Explain the code at ', {_TARGET}, '.', CASE WHEN question <> '' THEN concat(' Specifically: ', question) ELSE '' END) AS question,
  concat('[explain] ', file_path, CASE WHEN start_line <> 0 THEN concat(':', start_line) ELSE '' END) AS turn_label
  FROM t WHERE file_path IS NOT NULL"""


@query("ctx_6_explain_requests", _EXPLAIN)
def explain(spark, sf_dir):
    rows = targets(spark, sf_dir).where(F.col("file_path").isNotNull())
    return assist.explain_requests(rows).select("query_id", "query", "question", "turn_label")


_FIRST_LINE = f"""list_filter(list_transform(string_split(user_code, chr(10)), lambda x: {q.strip('x')}), lambda x: x <> '')[1]"""
_REVIEW = f"""{TARGETS} SELECT query_id,
  left(coalesce({_SYMBOL}, nullif({q.stem('file_path')}, ''), {_FIRST_LINE}, 'code review'), 1000) AS query,
  sha256(concat('Perform a ', focus, ' code review.',
    CASE WHEN file_path IS NOT NULL THEN concat(chr(10), chr(10), 'Repository target: ', {_TARGET}) ELSE '' END,
    CASE WHEN user_code <> '' THEN concat(chr(10), chr(10), '{fixed.USER_CODE_LABEL}', chr(10), '```', chr(10), user_code, chr(10), '```') ELSE '' END)) AS question,
  concat('[review:', focus, '] ', coalesce(file_path, 'user-provided code')) AS turn_label,
  user_code IS NULL AS requires_evidence FROM t"""


@query("ctx_6_review_requests", _REVIEW)
def review_requests(spark, sf_dir):
    rows = assist.review_requests(targets(spark, sf_dir))
    return rows.select("query_id", "query", F.sha2("question", 256).alias("question"), "turn_label", "requires_evidence")


@query("fn_19_request_query", _EXPLAIN.replace("question,\n", "question,\n").replace("SELECT query_id, left", "SELECT query_id, 'explain' AS kind, left", 1)
       .split("  concat('Explain")[0].rstrip().rstrip(",") + " FROM t WHERE file_path IS NOT NULL")
def fn_19(spark, sf_dir):
    rows = targets(spark, sf_dir).where(F.col("file_path").isNotNull())
    text = tx.explain_query(F.col("file_path"), F.col("symbol"), F.col("question"))
    return rows.select("query_id", F.lit("explain").alias("kind"), text.alias("query"))


@query("fn_20_request_question", f"{TARGETS} SELECT query_id, concat('Explain the code at ', {_TARGET}, '.') AS question FROM t WHERE file_path IS NOT NULL")
def fn_20(spark, sf_dir):
    rows = targets(spark, sf_dir).where(F.col("file_path").isNotNull())
    text = tx.explain_question(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), F.lit(None).cast("string"))
    return rows.select("query_id", text.alias("question"))


@query("fn_21_turn_label", f"{TARGETS} SELECT query_id, concat('[review:', focus, '] ', coalesce(file_path, 'user-provided code')) AS label FROM t")
def fn_21(spark, sf_dir):
    return targets(spark, sf_dir).select("query_id", tx.review_label(F.col("focus"), F.col("file_path")).alias("label"))


@query("fn_22_evidence_view", RESULTS + """ SELECT query_id, chunk_id, score, sha256(chunk_text) AS text, 'semantic' AS sources FROM results
  UNION ALL SELECT query_id, chunk_id, score, sha256(left(chunk_text, 500)), NULL FROM results""")
def fn_22(spark, sf_dir):
    live = results(spark, sf_dir).withColumn("retrieval_sources", F.array(F.lit("semantic")))
    stored = results(spark, sf_dir).withColumn("snippet", tx.snippet(F.col("chunk_text")))
    return ev.evidence_view(live, stored).select(
        "query_id", "chunk_id", "score", F.sha2("text", 256).alias("text"),
        F.array_join("retrieval_sources", ",").alias("sources"),
    )


@query("cnv_1_snapshot", FITTED + " SELECT query_id, chunk_id, name, language, score, sha256(left(chunk_text, 500)) AS snippet FROM fitted")
def cnv_1(spark, sf_dir):
    rows = ev.fit_evidence(ev.select_evidence(results(spark, sf_dir)), questions(spark, sf_dir), SYSTEM, BUDGET)
    one = F.struct("chunk_id", *ev.CHUNK_COLUMNS)
    stored = rows.select("query_id", F.explode(ev.evidence_snapshot(F.array(one))).alias("e"))
    return stored.select("query_id", "e.chunk_id", "e.name", "e.language", "e.score", F.sha2("e.snippet", 256).alias("snippet"))


@query("cnv_2_detail", RESULTS + """, c AS (SELECT DISTINCT conv_id AS id FROM conversations UNION ALL SELECT -1)
  SELECT c.id, m.id AS message_id, m.role, row_number() OVER (PARTITION BY c.id ORDER BY m.created_at, m.id) AS place
  FROM c LEFT JOIN messages m ON m.conversation_id = c.id""")
def cnv_2(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    ids = ids.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    rows = conv.conversation_detail(ids, messages(spark, sf_dir))
    placed = ranking.position(rows, ["id"], ["said_at", "message_id"], "place")
    return placed.select("id", "message_id", "role", (F.col("place") + 1).alias("place"))


@query("jn_12_owned_conversation", """SELECT doc_id AS query_id FROM documents WHERE doc_id % 50 IN (SELECT DISTINCT conv_id FROM conversations)
  AND doc_id % 3 = (doc_id % 50) % 3 AND source = concat('src', (doc_id % 50) % 20)""")
def jn_12(spark, sf_dir):
    i = F.col("doc_id")
    asks = table(spark, sf_dir, "documents").select(
        i.alias("query_id"), (i % 50).alias("conversation_id"), (i % 3).alias("user_id"), F.col("source").alias("repository_id")
    )
    c = F.col("conv_id")
    known = table(spark, sf_dir, "conversations").select(
        c.alias("id"), (c % 3).alias("user_id"), F.concat(F.lit("src"), c % 20).alias("repository_id")
    ).distinct()
    return conv.owned(asks, known).select("query_id")


_ANSWERS = "conv_id * 100 + turn AS id, conv_id AS conversation_id, text AS user_content, CASE WHEN turn % 3 <> 1 THEN reverse(text) END AS answer"


@query("snk_3_record_turns", f"""SELECT conversation_id, role, content, position FROM (
  SELECT conversation_id, 'user' AS role, user_content AS content, 0 AS position, answer FROM (SELECT {_ANSWERS} FROM conversations)
  UNION ALL SELECT conversation_id, 'assistant', answer, 1, answer FROM (SELECT {_ANSWERS} FROM conversations)) WHERE answer IS NOT NULL""")
def snk_3(spark, sf_dir):
    answers = spark.sql(f"SELECT {_ANSWERS} FROM {{c}}", c=table(spark, sf_dir, "conversations"))
    empty = "array<struct<chunk_id:bigint,file_path:string,start_line:int,end_line:int,language:string,name:string,score:double,chunk_text:string>>"
    answers = answers.select(
        "*", F.array().cast(empty).alias("evidence"), F.lit("m").alias("model"),
        F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"),
    )
    turns = conv.record_turns(answers, F.lit("2026-01-01").cast("timestamp"))
    return turns.select("conversation_id", "role", "content", "position")


@query("srt_4_listing", RESULTS + """ SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM messages""")
def srt_4(spark, sf_dir):
    return conv.listing_places(messages(spark, sf_dir), "created_at").select("id", "place")


# ---- reviews ------------------------------------------------------------------

REVIEWS = with_tables("reviews")


@query("rev_1_parse_review", REVIEWS + r""" SELECT doc_id, doc_id % 6 IN (0, 1, 4, 5) AS structured,
  CASE WHEN doc_id % 6 IN (0, 1, 5) THEN 'Sum' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS summary FROM reviews""")
def rev_1(spark, sf_dir):
    rows = review.parse_review(table(spark, sf_dir, "reviews"))
    return rows.select("doc_id", F.col("parsed").isNotNull().alias("structured"), "summary")


_FINDINGS = """SELECT doc_id, 0 AS item, concat('T', doc_id) AS title, 'high' AS severity, concat(lang, '/f.py') AS file_path,
    doc_id % 50 AS start_line, NULL::BIGINT AS end_line, NULL AS recommendation, '1,3,99' AS sources FROM documents WHERE doc_id % 6 IN (0, 1, 4, 5)
  UNION ALL SELECT doc_id, 4, 'U', NULL, NULL, NULL, doc_id, concat('fix ', source), '' FROM documents WHERE doc_id % 6 IN (0, 1, 4, 5)"""


def findings(spark, sf_dir):
    return review.explode_findings(review.parse_review(table(spark, sf_dir, "reviews")), "doc_id")


@query("rev_2_findings", _FINDINGS)
def rev_2(spark, sf_dir):
    rows = findings(spark, sf_dir)
    listed = F.array_join(F.transform("evidence_sources", lambda n: n.cast("string")), ",")
    return rows.select("doc_id", "item", "title", "severity", "file_path", "start_line", "end_line",
                       "recommendation", listed.alias("sources"))


def _numbered(spark, sf_dir):
    """Four pieces of evidence per review, taken from the conversations of the same number."""
    rows = table(spark, sf_dir, "messages").select(
        F.col("conversation_id").alias("doc_id"), (F.col("id") % 100 + 1).alias("evidence_rank"),
        F.col("id").alias("chunk_id"), F.concat("role", F.lit(".py")).alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
    )
    return rows


_CITED = f"""{with_tables('messages')}, f AS ({_FINDINGS}), cited AS (SELECT doc_id, item, place, CAST(n AS BIGINT) AS n FROM (
    SELECT doc_id, item, unnest([0, 1, 2]) AS place, unnest([1, 3, 99]) AS n FROM f WHERE item = 0)),
  hits AS (SELECT c.doc_id, c.item, c.place, m.id AS chunk_id, m.role FROM cited c JOIN messages m
    ON m.conversation_id = c.doc_id AND m.id % 100 + 1 = c.n)"""


@query("jn_7_finding_evidence", f"{_CITED} SELECT doc_id, item, place, chunk_id FROM hits")
def jn_7(spark, sf_dir):
    rows = review.finding_evidence(findings(spark, sf_dir), _numbered(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "item", "place", "chunk_id")


@query("rev_3_finding_cards", f"""{_CITED}, listed AS (SELECT doc_id, item, string_agg(concat(role, '.py:1-9'), ', ' ORDER BY place) AS supported_by FROM hits GROUP BY 1, 2)
  SELECT f.doc_id, f.item, f.title, {q.location('file_path', 'start_line', 'end_line')} AS location, coalesce(l.supported_by, '') AS supported_by
  FROM f LEFT JOIN listed l ON l.doc_id = f.doc_id AND l.item = f.item""")
def rev_3(spark, sf_dir):
    cards = review.finding_cards(findings(spark, sf_dir), _numbered(spark, sf_dir), "doc_id")
    return cards.select("doc_id", "item", "title", "location", F.array_join("supported_by", ", ").alias("supported_by"))


@query("jn_8_cited_chunks", f"""{_CITED}, listed AS (SELECT doc_id, item, string_agg(chunk_id, ',' ORDER BY place) AS ids FROM hits GROUP BY 1, 2)
  SELECT f.doc_id, f.item, coalesce(l.ids, '') AS ids FROM f LEFT JOIN listed l ON l.doc_id = f.doc_id AND l.item = f.item""")
def jn_8(spark, sf_dir):
    cards = review.finding_cards(findings(spark, sf_dir), _numbered(spark, sf_dir), "doc_id")
    return cards.select("doc_id", "item", F.array_join("evidence_chunk_ids", ",").alias("ids"))
