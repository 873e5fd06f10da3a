"""From ranked results to bounded, cited contexts (CTX-1 to CTX-5, CNV-1).

All qualifying chunks of a query are ranked; the token budget then bounds what a
context holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode import fixed
from codelode.functions import text as tx
from codelode.operators.ranking import budget_prefix, recent_messages

CHUNK_COLUMNS = (
    "file_path", "start_line", "end_line", "language", "name", "chunk_text", "score",
)
_WRAPPER = "Repository evidence:\n\n\n\n---\n\nQuestion: "


def best_per_chunk(results: DataFrame) -> DataFrame:
    """AGG-12: the highest-scored row of each chunk per query."""
    rest = [c for c in results.columns if c not in ("query_id", "chunk_id")]
    best = F.max_by(F.struct(*rest), F.col("score")).alias("_best")
    return results.groupBy("query_id", "chunk_id").agg(best).select(
        "query_id", "chunk_id", "_best.*"
    )


def select_evidence(results: DataFrame, lowest: float = fixed.MIN_RELEVANCE) -> DataFrame:
    """CTX-1: qualifying rows with ``evidence_rank`` 1..n (WIN-5)."""
    kept = results.where((F.col("score") >= lowest) & tx.has_text(F.col("chunk_text")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    best = best_per_chunk(kept.drop("rank"))
    return best.withColumn("evidence_rank", F.row_number().over(order))


def base_tokens(system_text: str, question: Column) -> Column:
    """Cost of the parts that are never dropped."""
    system = tx.message_tokens(F.lit(system_text))
    return system + tx.estimate_tokens(F.concat(F.lit(_WRAPPER), question))


def fit_evidence(
    evidence: DataFrame,
    questions: DataFrame,
    system_text: str,
    budget: int = fixed.TOKEN_BUDGET,
) -> DataFrame:
    """CTX-2: evidence in rank order while it fits, with its rendered ``block``.

    Queries whose fixed parts alone exceed the budget keep nothing.
    """
    rows = evidence.join(questions.select("query_id", "question"), "query_id")
    rows = rows.withColumn(
        "block", tx.evidence_block(F.col("evidence_rank"), {c: F.col(c) for c in CHUNK_COLUMNS})
    ).withColumn("base", base_tokens(system_text, F.col("question")))
    fitted = budget_prefix(
        rows, ["query_id"], [F.col("evidence_rank")],
        tx.estimate_tokens(F.col("block")), F.col("base"), budget,
    )
    return fitted.drop("question", "base")


def fit_history(
    messages: DataFrame,
    used: DataFrame,
    most: int = fixed.HISTORY_MESSAGES,
    budget: int = fixed.TOKEN_BUDGET,
) -> DataFrame:
    """CTX-3: the newest messages that still fit; order by ``recency`` descending to read.

    ``used(query_id, conversation_id, tokens_used)`` gives the tokens taken so
    far. ``most`` 0 or less keeps nothing.
    """
    recent = recent_messages(messages, max(most, 0)).join(used, "conversation_id")
    return budget_prefix(
        recent, ["query_id"], [F.col("recency")],
        tx.message_tokens(F.col("content")), F.col("tokens_used"), budget,
        fixed.MESSAGE_OVERHEAD_TOKENS,
    )


def context_status(
    qualifying: Column, fitted: Column, base: Column, required: Column, budget: int
) -> Column:
    """CTX-5, in the order in which conditions are noticed."""
    return (
        F.when(required & (qualifying == 0), "insufficient_evidence")
        .when(base > budget, "context_overflow")
        .when(required & (fitted == 0), "insufficient_evidence")
        .otherwise("ready")
    )


def _message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def build_context(
    results: DataFrame,
    questions: DataFrame,
    messages: DataFrame | None = None,
    system_text: str = "",
    lowest: float = fixed.MIN_RELEVANCE,
    budget: int = fixed.TOKEN_BUDGET,
    most_history: int = fixed.HISTORY_MESSAGES,
) -> DataFrame:
    """CTX-4: one row per question with status, messages, evidence and token count.

    ``questions(query_id, question, conversation_id, requires_evidence,
    indexed)``; the last three are optional columns.
    """
    for name, default in (
        ("conversation_id", F.lit(None).cast("long")),
        ("requires_evidence", F.lit(True)),
        ("indexed", F.lit(True)),
    ):
        if name not in questions.columns:
            questions = questions.withColumn(name, default)
    evidence = select_evidence(results, lowest)
    qualifying = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("qualifying"))
    considered = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("considered"))
    fitted = fit_evidence(evidence, questions, system_text, budget)
    snapshot = F.struct(
        "evidence_rank", "chunk_id", "file_path", "start_line", "end_line", "language", "name",
        "score", "block", "chunk_text",
    )
    packed = fitted.groupBy("query_id").agg(
        F.array_sort(F.collect_list(snapshot)).alias("evidence"),
        F.max("tokens_after").alias("evidence_tokens"),
    )
    rows = (
        questions.withColumn("base", base_tokens(system_text, F.col("question")))
        .join(qualifying, "query_id", "left")
        .join(considered, "query_id", "left")
        .join(packed, "query_id", "left")
        .withColumn("qualifying", F.coalesce("qualifying", F.lit(0)))
        .withColumn("fitted", F.coalesce(F.size("evidence"), F.lit(0)))
    )
    rows = rows.withColumn("fitted", F.greatest("fitted", F.lit(0)))
    status = F.when(~F.col("indexed"), "not_indexed").otherwise(
        context_status(
            F.col("qualifying"), F.col("fitted"), F.col("base"), F.col("requires_evidence"), budget
        )
    )
    rows = rows.withColumn("status", status).withColumn(
        "tokens_used", F.coalesce("evidence_tokens", "base")
    )
    if messages is None:
        history = F.array().cast("array<struct<recency:int,role:string,content:string>>")
        rows = rows.withColumn("history", history).withColumn("history_tokens", F.lit(None).cast("long"))
    else:
        used = rows.where((F.col("status") == "ready") & F.col("conversation_id").isNotNull())
        kept = fit_history(
            messages, used.select("query_id", "conversation_id", "tokens_used"), most_history, budget
        )
        # At most ``most_history`` messages per question.
        packed_history = kept.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("recency", "role", "content")), asc=False).alias(
                "history"
            ),
            F.max("tokens_after").alias("history_tokens"),
        )
        rows = rows.join(packed_history, "query_id", "left")
    blocks = F.array_join(F.transform("evidence", lambda e: e["block"]), "\n\n")
    asked = F.concat(F.lit("Question: "), F.col("question"))
    cited = F.concat(F.lit("Repository evidence:\n\n"), blocks, F.lit("\n\n---\n\n"), asked)
    turn = F.when(F.col("fitted") > 0, cited).otherwise(asked)
    past = F.transform(
        F.coalesce("history", F.array().cast("array<struct<recency:int,role:string,content:string>>")),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )
    conversation = F.concat(
        F.array(_message("system", F.lit(system_text))), past, F.array(_message("user", turn))
    )
    ready = F.col("status") == "ready"
    return rows.select(
        "query_id",
        "status",
        F.when(ready, conversation).alias("messages"),
        F.when(ready, F.col("evidence")).alias("evidence"),
        F.when(ready, F.coalesce("history_tokens", "tokens_used")).alias("tokens_used"),
        "qualifying",
        F.when(ready, F.col("fitted")).alias("evidence_used"),
        F.when(ready, F.size(past)).alias("history_used"),
        F.when(ready, F.coalesce("considered", F.lit(0))).alias("evidence_considered"),
    )


def evidence_snapshot(evidence: Column) -> Column:
    """CNV-1: the stored form of used evidence, with a bounded snippet."""
    kept = ("chunk_id", "file_path", "start_line", "end_line", "language", "name", "score")
    return F.transform(
        evidence,
        lambda e: F.struct(
            *[e[c].alias(c) for c in kept], tx.snippet(e["chunk_text"]).alias("snippet")
        ),
    )


def evidence_view(live: DataFrame, stored: DataFrame) -> DataFrame:
    """FN-22: live results and stored citations in one shape; stored rows have no sources."""
    shape = ("query_id", "chunk_id", "file_path", "start_line", "end_line", "language", "name", "score")
    now = live.select(*shape, F.col("chunk_text").alias("text"), "retrieval_sources")
    then = stored.select(*shape, F.col("snippet").alias("text"))
    return now.unionByName(then, allowMissingColumns=True)
