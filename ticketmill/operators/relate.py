"""Joins and set operations between tickets, answers, records and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .sequences import next_after


def records_with_feedback(records: DataFrame, feedback: DataFrame, run: str) -> DataFrame:
    """All records of a run, each with its feedback rows if it has any.

    A left join, written as the matches and the records without one: a record with very many
    feedback rows can be split in an inner join, but not on the right side of an outer join.
    """
    of_run = records.filter(F.col("tags") == run)
    rated = feedback.select("record_id").distinct()
    return of_run.join(feedback, "record_id").unionByName(
        of_run.join(rated, "record_id", "left_anti"), allowMissingColumns=True
    )


def feedback_of_run(feedback: DataFrame, records: DataFrame, run: str) -> DataFrame:
    """Feedback rows whose record belongs to the run."""
    return feedback.join(records.filter(F.col("tags") == run), "record_id", "left_semi")


def with_current_conversation(listing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The listing, with the running conversations in front that it lacks.

    ``position`` is 0 for those added and 1 for listed rows, as a table keeps no order.
    """
    missing = current.join(listing, key, "left_anti")
    listed = listing.withColumn("position", F.lit(1))
    return missing.withColumn("position", F.lit(0)).unionByName(listed, allowMissingColumns=True)


def with_fallback_output(tickets: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Tickets with their agent output, or the fallback labels where there is none."""
    defaults = {
        "priority_level": V.DEFAULT_PRIORITY,
        "topic": V.FALLBACK_LABEL,
        "intent": V.FALLBACK_LABEL,
    }
    joined = tickets.join(outputs.withColumn("_answered", F.lit(True)), key, "left")
    answered = F.col("_answered").isNotNull()
    for column, default in defaults.items():
        joined = joined.withColumn(column, F.when(answered, F.col(column)).otherwise(default))
    empty = F.array().cast("array<string>")
    return joined.withColumn(
        "retrieved_context", F.when(answered, F.col("retrieved_context")).otherwise(empty)
    ).drop("_answered")


def answers_with_ground_truth(answers: DataFrame, testset: DataFrame) -> DataFrame:
    """Pair each agent answer with the query, the expected answer and the ticket attributes."""
    return testset.join(answers, "ticket_id")


def qa_pairs(messages: DataFrame) -> DataFrame:
    """Every user turn with the next assistant turn of its conversation.

    Only turn numbers pass through the ordered step; the texts are joined on (conversation, turn),
    which is unique, so a long conversation is spread like any other rows.
    """
    reply_turn = F.when(F.col("role") == "assistant", F.col("turn"))
    turns = next_after(
        messages.select("conv_id", "turn", "role"), ["conv_id"], "turn", reply_turn, "answer_turn"
    ).filter("role = 'user' and answer_turn is not null")
    asked = messages.select("conv_id", "turn", F.col("text").alias("body"))
    replied = messages.select(
        "conv_id", F.col("turn").alias("answer_turn"), F.col("text").alias("answer")
    )
    return (
        turns.select("conv_id", "turn", "answer_turn")
        .join(asked, ["conv_id", "turn"])
        .join(replied, ["conv_id", "answer_turn"])
        .select("conv_id", "turn", "answer_turn", "body", "answer")
    )


def distinct_tags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values over several tag columns."""
    return (
        df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("tag"))
        .filter("tag is not null")
        .distinct()
    )


def union_tags(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same set as a union of one select per column; each branch reads one column only."""
    first, *rest = [df.select(F.col(c).alias("tag")) for c in columns]
    for part in rest:
        first = first.unionByName(part)
    return first.filter("tag is not null").distinct()


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """The k best rows of every group with their rank; a k of 0 or None means the default.

    Spark keeps only k rows per group and task before the shuffle.
    """
    ranked = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")
    return df.withColumn("rank", ranked).filter(F.col("rank") <= (k or V.TOP_K))


def tool_limit(asked: int | None) -> int:
    """Number of results a search tool call may ask for."""
    return min(asked or V.TOOL_TOP_K, V.TOOL_TOP_K_MAX)
