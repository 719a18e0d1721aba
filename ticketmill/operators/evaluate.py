"""Scores of answers against query, context and expected answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import (
    extract_context,
    extract_message_text,
    extract_tool_steps,
    extract_usage,
    parse_judge_response,
)
from ..functions.text import let, render_prompt, sentences, words
from . import prompts as P
from .curate import default_missing_column
from .inference import Client, batch_complete
from .profile import METRICS, average_score

CLAIM_SHARE = 0.5
CHUNK_SHARE = 0.3
CONTEXT_GAP = "\n\n"

JUDGE_TEMPLATES = {
    "faithfulness": (P.FAITHFULNESS, ["context", "answer"]),
    "answer_relevancy": (P.ANSWER_RELEVANCY, ["query", "answer"]),
    "context_precision": (P.CONTEXT_PRECISION, ["query", "context"]),
    "context_recall": (P.CONTEXT_RECALL, ["query", "ground_truth", "context"]),
}


def _found_share(needles: Column, haystack: Column) -> Column:
    """Share of the distinct words on the left that occur on the right, 0 without words."""

    def share(wanted: Column) -> Column:
        found = F.size(F.array_intersect(wanted, haystack))
        return F.coalesce(F.try_divide(found, F.size(wanted)), F.lit(0.0))

    return let(F.array_distinct(needles), share)


def _share_of(items: Column, keep: Callable[[Column], Column]) -> Column:
    """Share of the word lists that pass the test; lists without words do not count."""
    return let(
        F.filter(items, lambda w: F.size(w) > 0),
        lambda lists: F.coalesce(
            F.try_divide(F.size(F.filter(lists, keep)), F.size(lists)), F.lit(0.0)
        ),
    )


def _backed_sentences(text: str, source: str) -> Column:
    """Share of a text's sentences with most of their words in the source.

    The source is looked through once, for the text's words it lacks; each sentence is then held
    against that short list instead of the whole source.
    """
    claims = F.transform(sentences(F.col(text)), words)

    def backed(claim: Column, lacking: Column) -> Column:
        def enough(wanted: Column) -> Column:
            lost = F.size(F.array_intersect(wanted, lacking))
            return (F.size(wanted) - lost) / F.size(wanted) >= CLAIM_SHARE

        return let(F.array_distinct(claim), enough)

    def share(claimed: Column) -> Column:
        return let(
            F.array_except(F.flatten(claimed), words(F.col(source))),
            lambda lacking: _share_of(claimed, lambda claim: backed(claim, lacking)),
        )

    return let(claims, share)


def metric_faithfulness(answer: str = "agent_answer", context: str = "context") -> Column:
    """Supported claims of all claims."""
    return _backed_sentences(answer, context)


def metric_context_recall(ground_truth: str = "ground_truth", context: str = "context") -> Column:
    """Points of the expected answer that the context holds, of all its points."""
    return _backed_sentences(ground_truth, context)


def metric_answer_relevancy(query: str = "query", answer: str = "agent_answer") -> Column:
    """Share of the query's words that the answer takes up."""
    return _found_share(words(F.col(query)), words(F.col(answer)))


def metric_context_precision(query: str = "query", context: str = "context") -> Column:
    """Chunks that hold enough of the query's words, of all chunks."""
    chunks = F.transform(F.split(context, CONTEXT_GAP), words)
    return let(
        words(F.col(query)),
        lambda asked: _share_of(chunks, lambda w: _found_share(asked, w) >= CHUNK_SHARE),
    )


def rule_scores(df: DataFrame) -> DataFrame:
    """The four scores from word overlap, for rows of query, ground_truth, agent_answer, context."""
    return df.select(
        "*",
        metric_faithfulness().alias("faithfulness_score"),
        metric_answer_relevancy().alias("answer_relevancy_score"),
        metric_context_precision().alias("context_precision_score"),
        metric_context_recall().alias("context_recall_score"),
    ).withColumn("average_score", average_score())


def judge_prompts(templates: Mapping[str, tuple[str, list[str]]] = JUDGE_TEMPLATES) -> dict[str, Column]:
    """One prompt column per metric; holes are filled in the order listed."""
    columns = {
        "query": F.col("query"),
        "answer": F.col("agent_answer"),
        "context": F.col("context"),
        "ground_truth": F.col("ground_truth"),
    }
    return {
        f"{metric}_response": render_prompt(template, {h: columns[h] for h in holes})
        for metric, (template, holes) in templates.items()
    }


def score_batch(
    df: DataFrame,
    make_client: Callable[[], Client],
    templates: Mapping[str, tuple[str, list[str]]] = JUDGE_TEMPLATES,
) -> DataFrame:
    """Score and explanation per metric from a judging model, and the row's average score.

    ``<metric>_parse_ok`` tells whether there was a readable answer and ``<metric>_error`` shows an
    unreadable one; ``judge_error`` is the last failed call of the row. All four prompts of a row go through one Python stage; working columns are dropped at the end.
    """
    answered = batch_complete(df, judge_prompts(templates), make_client)
    for metric in METRICS:
        answered = answered.withColumn(
            f"_{metric}", parse_judge_response(F.col(f"{metric}_response"))
        )
    for metric in METRICS:
        answered = answered.withColumn(
            f"{metric}_score", F.col(f"_{metric}.score")
        ).withColumns(
            {
                f"{metric}_explanation": F.col(f"_{metric}.explanation"),
                f"{metric}_parse_ok": F.col(f"_{metric}.parse_ok"),
                f"{metric}_error": F.col(f"_{metric}.error"),
            }
        )
    return answered.withColumn("average_score", average_score()).drop(
        *[f"{m}_response" for m in METRICS], *[f"_{m}" for m in METRICS]
    ).withColumnRenamed("errors", "judge_error")


def run_batch_evaluation(
    testset: DataFrame, make_agent: Callable[[], Client], make_judge: Callable[[], Client]
) -> DataFrame:
    """The results table: the agent's answer to every ticket of the test set, and its scores.

    ``testset`` has ticket_id, rewritten_body and cleaned_answer; attributes it lacks become N/A.
    The agent returns its response as JSON, with the steps it took and the tokens it used.
    """
    for attribute in ["language", "priority", "type"]:
        testset = default_missing_column(testset, attribute)
    answered = batch_complete(testset, {"_response": F.col("rewritten_body")}, make_agent)
    read = answered.withColumn("_steps", extract_tool_steps(F.col("_response"))).withColumn(
        "_usage", extract_usage(F.col("_response"))
    )
    results = read.select(
        "ticket_id",
        "language",
        "priority",
        "type",
        F.col("rewritten_body").alias("query"),
        F.col("cleaned_answer").alias("ground_truth"),
        extract_message_text(F.col("_response")).alias("agent_answer"),
        extract_context(F.col("_steps.tool_results")).alias("context"),
        F.col("_steps.used_search").alias("used_search"),
        "_usage.agent_model",
        "_usage.total_input_tokens",
        "_usage.total_output_tokens",
        F.col("errors").alias("agent_error"),
    )
    return score_batch(results, make_judge)


def priority_accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts with the accuracy over all rows."""
    counts = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    hits = F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0))
    accuracy = counts.agg(F.round(hits / F.sum("n"), 6)).scalar()
    return counts.withColumn("accuracy", accuracy)


def classifier_validation(df: DataFrame, label: str, predicted: str, minimum: float = 0.8) -> DataFrame:
    """Agreement with hand labels, and whether it is high enough to go on."""
    agreement = F.avg((F.col(label) == F.col(predicted)).cast("int"))
    return df.agg(
        F.count("*").alias("n"),
        F.round(agreement, 6).alias("agreement"),
        (agreement >= minimum).alias("passed"),
    )


def with_run(results: DataFrame, run_id: str) -> DataFrame:
    return results.withColumn("run_id", F.lit(run_id))


def run_row(spark, run_id: str, commit: str, model: str, date: str) -> DataFrame:
    """One row for the table of runs: run_id, commit_sha, model, date."""
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(commit).alias("commit_sha"),
        F.lit(model).alias("model"),
        F.to_timestamp_ntz(F.lit(date)).alias("date"),
    )
