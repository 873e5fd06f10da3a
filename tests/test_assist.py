"""From requests to stored turns in one plan."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelode import fixed
from codelode.plans import assist

CHUNK = (
    "chunk_id long, repository_id int, ingestion_id int, file_path string, language string, chunk_type string, name string, "
    "start_line int, end_line int, chunk_text string, embedding array<float>"
)
now = lambda: F.lit("2026-01-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    chunk = lambda i, repo, path, text, name=None: (i, repo, repo, path, "Python", "function", name, 1, 9, text, [1.0, 0.0])
    chunks = spark.createDataFrame(
        [chunk(1, 1, "auth/token.py", "def verify token expiry", "verify"), chunk(2, 1, "auth/login.py", "login form and token"), chunk(3, 1, "misc/z.py", "nothing alike")],
        CHUNK,
    )
    runs = spark.createDataFrame(
        [(1, 1, "completed", dt(2026, 1, 1)), (2, 2, "failed", dt(2026, 1, 1))], "id int, repository_id int, status string, created_at timestamp_ntz"
    )
    asks = spark.createDataFrame([(1, 1, "verify token expiry"), (2, 1, "stripe payment refunds"), (3, 2, "verify token"), (4, 1, "token " + "x" * 3900), (5, 1, "verify token")], "query_id long, repository_id int, message string")
    requests = assist.ask_requests(asks).withColumn("conversation_id", F.when(F.col("query_id") != 5, F.col("query_id") * 10))
    said = spark.createDataFrame([(1, 10, "user", "before", dt(2025, 1, 1)), (2, 10, "assistant", "indeed", dt(2025, 1, 1))], "id long, conversation_id long, role string, content string, created_at timestamp_ntz")
    contexts = assist.prepare(requests, chunks, runs, said, "Be exact.", budget=900)
    responses = spark.createDataFrame([(1, "It is verified. [Source 1]", "m", 50, 9), (2, "never asked", "m", 1, 1)], "query_id long, text string, model string, input_tokens int, output_tokens int")
    return contexts, assist.conclude(contexts, responses)


def test_contexts_have_their_status(tables):
    rows = {r["query_id"]: r for r in tables[0].collect()}
    assert {q: r["status"] for q, r in rows.items()} == {1: "ready", 2: "insufficient_evidence", 3: "not_indexed", 4: "context_overflow", 5: "ready"}
    first = rows[1]
    assert [m["role"] for m in first["messages"]] == ["system", "user", "assistant", "user"]
    assert first["messages"][0]["content"] == "Be exact." and "verify token expiry" in first["messages"][-1]["content"]
    assert first["evidence"][0]["chunk_id"] == 1
    assert first["evidence_considered"] >= first["evidence_used"] >= 1 and rows[2]["evidence_considered"] is None
    assert all(rows[q]["messages"] is None for q in (2, 3, 4))


def test_answers_and_their_status(tables):
    rows = {r["query_id"]: r for r in tables[1].collect()}
    assert {q: r["status"] for q, r in rows.items()} == {1: "answered", 2: "insufficient_evidence", 3: "not_indexed", 4: "context_overflow", 5: "no_response"}
    assert rows[1]["answer"].startswith("It is verified") and rows[1]["model"] == "m" and rows[1]["evidence"]
    # The model is never asked without evidence, and a text for such a request is not taken for an answer.
    assert rows[2]["answer"] == fixed.MSG_INSUFFICIENT and rows[2]["model"] is None and rows[2]["evidence"] is None
    assert all(rows[q]["answer"] is None for q in (3, 4, 5))


def test_turns_are_written_once(spark, tables, tmp_path):
    turns = assist.new_turns(tables[1], now())
    rows = sorted((r["conversation_id"], r["position"], r["role"]) for r in turns.collect())
    assert rows == [(10, 0, "user"), (10, 1, "assistant"), (20, 0, "user"), (20, 1, "assistant")]
    turns.write.parquet(str(tmp_path / "messages"))
    stored = spark.read.parquet(str(tmp_path / "messages"))
    assert assist.new_turns(tables[1], now(), stored).collect() == []
    snippet = {r["conversation_id"]: r["evidence"] for r in stored.where("role = 'assistant'").collect()}
    assert snippet[10][0]["snippet"].startswith("def verify") and snippet[20] is None


def test_reviews_end_as_findings(spark, tables):
    body = '{"summary": "S", "findings": [{"title": "Expiry", "severity": "high", "file_path": "auth/token.py", "start_line": 3, "evidence_sources": [1, 9]}]}'
    answers = assist.conclude(tables[0], spark.createDataFrame([(1, body, "m", 1, 1)], "query_id long, text string, model string, input_tokens int, output_tokens int"))
    found = assist.review_findings(answers).collect()
    assert [(r["query_id"], r["title"], r["location"], r["evidence_chunk_ids"], r["supported_by"]) for r in found] == [(1, "Expiry", "auth/token.py:3", ["1"], ["auth/token.py:1-9"])]
