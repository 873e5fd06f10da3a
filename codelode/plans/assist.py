"""Ask, explain and review: requests (CTX-6), and the plan from a request to its stored turn (CTX-1 to CTX-5, REV-1 to
REV-3, SNK-3).

``prepare`` searches and assembles a context for each request, with a status
where there is none; ``conclude`` meets the contexts with response texts, from
wherever they come; ``new_turns`` gives the messages to store, once however
often the same answers are recorded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode import fixed
from codelode.functions import text as tx
from codelode.operators import review
from codelode.operators.conversations import record_turns
from codelode.operators.evidence import build_context
from codelode.plans.search import not_indexed, search, with_defaults


def ask_requests(asks: DataFrame) -> DataFrame:
    """Search request of ``asks(query_id, repository_id, message)``."""
    return asks.select(
        "query_id",
        "repository_id",
        F.col("message").alias("query"),
        F.col("message").alias("question"),
        F.lit("hybrid").alias("mode"),
        F.lit(fixed.ASSIST_TOP_K).alias("top_k"),
        F.lit(None).cast("array<string>").alias("file_paths"),
        F.lit(True).alias("requires_evidence"),
        F.col("message").alias("turn_label"),
    )


def explain_requests(explains: DataFrame) -> DataFrame:
    """Search request of ``explains(query_id, repository_id, file_path, start_line,
    end_line, symbol, question)``, scoped to the file."""
    path, symbol, question = F.col("file_path"), F.col("symbol"), F.col("question")
    start, end = F.col("start_line"), F.col("end_line")
    return explains.select(
        "query_id",
        "repository_id",
        tx.explain_query(path, symbol, question).alias("query"),
        tx.explain_question(path, start, end, symbol, question).alias("question"),
        F.lit("hybrid").alias("mode"),
        F.lit(fixed.ASSIST_TOP_K).alias("top_k"),
        F.array(path).alias("file_paths"),
        F.lit(True).alias("requires_evidence"),
        tx.explain_label(path, start).alias("turn_label"),
    )


def review_requests(reviews: DataFrame, response_format: str = "") -> DataFrame:
    """Search request of ``reviews(query_id, repository_id, focus, file_path, symbol,
    start_line, end_line, user_code)``; evidence is optional for user-supplied code."""
    path, symbol, code = F.col("file_path"), F.col("symbol"), F.col("user_code")
    start, end, focus = F.col("start_line"), F.col("end_line"), F.col("focus")
    scoped = F.when(F.coalesce(path, F.lit("")) != "", F.array(path))
    return reviews.select(
        "query_id",
        "repository_id",
        tx.review_query(path, symbol, code).alias("query"),
        tx.review_question(focus, path, start, end, symbol, code, response_format).alias("question"),
        F.lit("hybrid").alias("mode"),
        F.lit(fixed.ASSIST_TOP_K).alias("top_k"),
        scoped.alias("file_paths"),
        code.isNull().alias("requires_evidence"),
        tx.review_label(focus, path).alias("turn_label"),
    )


def prepare(
    requests: DataFrame,
    chunks: DataFrame,
    runs: DataFrame,
    messages: DataFrame | None = None,
    system_text: str = "",
    index: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """A context for each of ``requests`` (rows of the three functions above, with ``query_vector`` and
    ``conversation_id`` where they have them).

    ``status`` is ``ready``, ``insufficient_evidence``, ``context_overflow`` or
    ``not_indexed``; only ready rows have messages.
    """
    if "query_vector" not in requests.columns:
        requests = requests.withColumn("query_vector", F.lit(None).cast("array<float>"))
    asked = requests.drop("question", "requires_evidence", "turn_label", "conversation_id")
    found = search(asked, chunks, runs, index=index)
    missing = not_indexed(with_defaults(asked), runs).select("query_id", F.lit(False).alias("_indexed"))
    kept = [c for c in ("question", "requires_evidence", "conversation_id") if c in requests.columns]
    questions = requests.select("query_id", *kept).join(missing, "query_id", "left")
    questions = questions.withColumn("indexed", F.coalesce("_indexed", F.lit(True))).drop("_indexed")
    built = build_context(found, questions, messages, system_text, **limits)
    carried = [c for c in ("conversation_id", "turn_label") if c in requests.columns]
    return built.join(requests.select("query_id", "repository_id", *carried), "query_id")


def conclude(contexts: DataFrame, responses: DataFrame) -> DataFrame:
    """One answer per context: ``responses(query_id, text, model, input_tokens, output_tokens)`` meet the ready ones.

    A request without enough evidence is answered with a fixed text and no
    model; an overflow, a missing index or a ready context without a response
    has no answer, and ``status`` says which.
    """
    rows = contexts.join(responses.withColumnRenamed("text", "_text"), "query_id", "left")
    ready, short = F.col("status") == "ready", F.col("status") == "insufficient_evidence"
    answered = ready & F.col("_text").isNotNull()
    status = F.when(answered, "answered").when(ready, "no_response").otherwise(F.col("status"))
    given = lambda name: F.when(answered, F.col(name)).alias(name)
    carried = [c for c in ("conversation_id", "turn_label") if c in contexts.columns]
    return rows.select(
        "query_id", "repository_id", *carried,
        status.alias("status"),
        F.when(answered, F.col("_text")).when(short, fixed.MSG_INSUFFICIENT).alias("answer"),
        given("evidence"), given("model"), given("input_tokens"), given("output_tokens"),
    )


def review_findings(answers: DataFrame) -> DataFrame:
    """Findings of answered reviews with the places that they cite, one row each (REV-1 to REV-3)."""
    answered = answers.where("status = 'answered'")
    parsed = review.parse_review(answered.select("query_id", F.col("answer").alias("text")))
    evidence = answered.where("evidence IS NOT NULL").select("query_id", F.inline("evidence"))
    return review.finding_cards(review.explode_findings(parsed), evidence)


def new_turns(answers: DataFrame, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """SNK-3 for answers with a conversation: the two messages of each turn, with a ``turn_key``.

    The key names the request and its conversation. Turns whose key ``stored``
    (the messages table) has are left out, so recording answers again adds
    nothing. Answers without enough evidence are turns too; requests without an
    answer are not.
    """
    key = F.sha2(F.concat_ws("/", F.col("conversation_id").cast("string"), F.col("query_id").cast("string"), "turn_label"), 256)
    keyed = answers.where(F.col("conversation_id").isNotNull() & F.col("answer").isNotNull()).withColumn("turn_key", key)
    if stored is not None:
        keyed = keyed.join(stored.select("turn_key").distinct(), "turn_key", "left_anti")
    return record_turns(keyed.withColumn("user_content", F.col("turn_label")), now, carry=("turn_key",))
