"""Conversations and their messages (SNK-3, CNV-2, JN-12, SRT-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.operators.evidence import evidence_snapshot
from codelode.operators.ranking import position

MESSAGE_COLUMNS = (
    "conversation_id", "role", "content", "evidence", "model", "input_tokens", "output_tokens",
    "created_at", "position",
)


def owned(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """JN-12: requests whose conversation belongs to their user and repository."""
    keys = ["conversation_id", "user_id", "repository_id"]
    mine = conversations.select(F.col("id").alias("conversation_id"), "user_id", "repository_id")
    return requests.join(mine, keys, "left_semi")


def record_turns(answers: DataFrame, now: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """SNK-3: the user and the assistant message of each answered request.

    ``answers(conversation_id, user_content, answer, evidence, model,
    input_tokens, output_tokens)``; a failed answer has a NULL ``answer`` and
    adds no message. ``position`` orders the two messages of a turn, which share
    one time stamp. ``carry`` names further columns that both messages keep.
    """
    done = answers.where(F.col("answer").isNotNull())
    stored = evidence_snapshot(F.col("evidence"))
    nothing = {
        "evidence": F.when(F.lit(False), stored),
        "model": F.lit(None).cast("string"),
        "input_tokens": F.lit(None).cast("int"),
        "output_tokens": F.lit(None).cast("int"),
    }

    def message(role: str, content: str, extra: dict[str, Column], position: int) -> Column:
        return F.struct(
            F.lit(role).alias("role"),
            F.col(content).alias("content"),
            *[extra[c].alias(c) for c in ("evidence", "model", "input_tokens", "output_tokens")],
            F.lit(position).alias("position"),
        )

    given = {
        "evidence": stored,
        "model": F.col("model"),
        "input_tokens": F.col("input_tokens").cast("int"),
        "output_tokens": F.col("output_tokens").cast("int"),
    }
    turn = F.array(
        message("user", "user_content", nothing, 0), message("assistant", "answer", given, 1)
    )
    rows = done.select("conversation_id", *carry, F.explode(turn).alias("m"), now.alias("created_at"))
    return rows.select("conversation_id", *carry, "m.*", "created_at").select(*MESSAGE_COLUMNS, *carry)


def touch_conversations(conversations: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """SNK-3: ``updated_at`` of every conversation that got a turn."""
    touched = (
        answers.where(F.col("answer").isNotNull())
        .select(F.col("conversation_id").alias("id"), F.lit(True).alias("_new"))
        .distinct()
    )
    stamp = F.when(F.col("_new"), now).otherwise(F.col("updated_at"))
    return conversations.join(touched, "id", "left").withColumn("updated_at", stamp).drop("_new")


def conversation_detail(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """CNV-2: conversations joined to their messages, to be read in row order.

    One row per message, so that no conversation is gathered into a single
    value however long it is; conversations without messages keep one row.
    """
    said = messages.select(
        F.col("conversation_id").alias("id"),
        F.col("id").alias("message_id"),
        "role",
        "content",
        F.col("created_at").alias("said_at"),
    )
    return conversations.join(said, "id", "left").orderBy("id", "said_at", "message_id")


def listing_places(df: DataFrame, newest_by: str) -> DataFrame:
    """SRT-4 as a column: ``place`` in the listing from 1, without gathering rows in one task."""
    newest = F.coalesce(-F.unix_micros(F.col(newest_by).cast("timestamp")), F.lit((1 << 63) - 1))
    rows = df.withColumn("_newest", newest).withColumn("_last", -F.col("id"))
    placed = position(rows, [], ["_newest", "_last"], "place").drop("_newest", "_last")
    return placed.withColumn("place", F.col("place") + 1)


def listing(df: DataFrame, newest_by: str) -> DataFrame:
    """SRT-4: newest first, ties by descending id."""
    return df.orderBy(F.col(newest_by).desc(), F.col("id").desc())
