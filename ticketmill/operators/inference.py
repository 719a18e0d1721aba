"""Batch inference: prompts for all rows, a pluggable model, answers as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import fixed_values as V
from ..functions.language import detect_language
from ..functions.payloads import join_context, parse_topic_intent
from ..functions.text import (
    normalize_label,
    normalize_priority,
    render_prompt,
    render_prompt_format,
    strip_prefixes,
)
from ..session import bound_batches, cut_lineage
from . import prompts as P
from . import rules as R
from .curate import dedup_exact, filter_min_length, select_columns_by_rule
from .retrieval import CellIndex, build_cells, embed, retrieve_text_chunks
from .sampling import sample_n

# A client takes a list of prompts and returns as many answers.
Client = Callable[[list[str]], list[str]]


def batch_complete(
    df: DataFrame,
    prompts: Mapping[str, Column],
    make_client: Callable[[], Client],
    batch_size: int = 64,
    retries: int = 2,
    tasks: int | None = None,
    share_answers: bool = False,
) -> DataFrame:
    """Add one answer column per prompt, and ``errors`` with the last failure of the row.

    The answers are written before they are handed on, so a prompt is sent once, however often and
    under whatever filter they are read; only a task that is run again asks again. ``make_client`` runs once per task. Only the prompts travel to the Python workers, all of them
    in one stage. A failing batch is tried again, then prompt by prompt, so that one bad prompt
    costs its own row only. A null prompt gets a null answer. A worker holds one Arrow batch of prompts,
    bounded by its bytes; a call has prompts of one such batch. ``tasks`` spreads a small table over
    more tasks than it has partitions, since a model call takes longer than reading its row.
    ``share_answers`` asks once for equal prompts and joins the answers back, which pays when a
    large part of the table are copies and the model answers equal prompts equally.
    """
    names = list(prompts)
    if share_answers:
        bundle = F.struct(*[prompts[n].alias(n) for n in names])
        keyed = df.withColumn("_key", F.sha2(F.to_json(bundle), 256)).withColumn("_prompts", bundle)
        once = keyed.groupBy("_key").agg(F.any_value("_prompts").alias("_prompts"))
        asked = {n: F.col(f"_prompts.{n}") for n in names}
        answers = batch_complete(once, asked, make_client, batch_size, retries, tasks)
        return keyed.drop("_prompts").join(answers.drop("_prompts"), "_key").drop("_key")
    return cut_lineage(_answered(df, prompts, make_client, batch_size, retries, tasks), "answers")


def _ask(client: Client, asked: list[str], retries: int) -> tuple[list[str | None], list[str | None]]:
    """(answers, errors) of prompts: a batch that keeps failing is asked prompt by prompt."""
    for _ in range(retries):
        try:
            answers = list(client(asked))
            if len(answers) != len(asked):
                raise ValueError(f"{len(asked)} prompts but {len(answers)} answers")
            return answers, [None] * len(asked)
        except Exception:
            continue
    answers, errors = [], []
    for prompt in asked:
        try:
            answers.append(client([prompt])[0])
            errors.append(None)
        except Exception as exc:
            answers.append(None)
            errors.append(f"{type(exc).__name__}: {exc}")
    return answers, errors


def _answered(
    df: DataFrame,
    prompts: Mapping[str, Column],
    make_client: Callable[[], Client],
    batch_size: int = 64,
    retries: int = 2,
    tasks: int | None = None,
) -> DataFrame:
    """The plan behind :func:`batch_complete`: one Python stage, not yet run."""
    bound_batches(df.sparkSession)
    names = list(prompts)
    fields = ", ".join(f"`{n}` string" for n in names) + ", `errors` string"

    def complete(client: Client, column: pd.Series) -> tuple[pd.Series, pd.Series]:
        answers = pd.Series([None] * len(column), dtype=object)
        errors = pd.Series([None] * len(column), dtype=object)
        rows = [i for i, prompt in enumerate(column) if prompt is not None]
        for start in range(0, len(rows), batch_size):
            part = rows[start : start + batch_size]
            got, failed = _ask(client, [column.iloc[i] for i in part], retries)
            for i, answer, error in zip(part, got, failed):
                answers.iat[i], errors.iat[i] = answer, error
        return answers, errors

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            out, errors = {}, pd.Series([None] * len(batch), dtype=object)
            for name in names:
                out[name], failed = complete(client, batch[name].astype(object))
                errors = failed.where(failed.notna(), errors)
            yield pd.DataFrame({**out, "errors": errors})

    if tasks:
        df = df.repartition(tasks)
    packed = F.struct(*[prompts[n].alias(n) for n in names])
    # Not deterministic: Spark may not run it again for a filter on an answer.
    answered = df.withColumn("_answers", run.asNondeterministic()(packed))
    return answered.select(
        *df.columns, *[F.col(f"_answers.{n}").alias(n) for n in [*names, "errors"]]
    )


def register_agent_function(
    spark: SparkSession, name: str, make_client: Callable[[], Client], batch_size: int = 64, retries: int = 2
) -> None:
    """A table function for SQL that answers the rows of a table.

    ``SELECT * FROM name(TABLE(tickets) PARTITION BY (pmod(hash(id), 64)), 'body')`` gives every row of the
    table with two more columns: ``response`` to the text in the named column, and ``error``. Rows are
    kept until there are ``batch_size`` of them, or the partition ends, and asked for together. A text
    whose call keeps failing keeps its row, with the error; a null text is not asked and has neither. A
    partition is worked on by one task and has a client of its own, so there should be more of them than
    tasks, and far fewer than rows.
    """

    class Agent:
        def __init__(self):
            self.client, self.rows, self.texts = make_client(), [], []

        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or text.value not in rows.dataType.names:
                raise ValueError("the arguments are a table and the name of its text column")
            added = StructType().add("response", "string").add("error", "string")
            return AnalyzeResult(StructType(rows.dataType.fields + added.fields))

        def _flush(self):
            asked = [i for i, text in enumerate(self.texts) if text is not None]
            got = [(None, None)] * len(self.rows)
            if asked:
                answers = _ask(self.client, [self.texts[i] for i in asked], retries)
                for i, answer, error in zip(asked, *answers):
                    got[i] = (answer, error)
            rows, self.rows, self.texts = self.rows, [], []
            for row, both in zip(rows, got):
                yield (*row, *both)

        def eval(self, row: Row, text: str):
            self.rows.append(tuple(row))
            self.texts.append(row[text])
            if len(self.rows) == batch_size:
                yield from self._flush()

        def terminate(self):
            yield from self._flush()

    spark.udtf.register(name, F.udtf(Agent))


def rewrite_tickets(
    df: DataFrame,
    make_client: Callable[[], Client] | None = None,
    body_prompt: str = P.REWRITE_BODY,
    answer_prompt: str = P.REWRITE_ANSWER,
) -> DataFrame:
    """Add ``rewritten_body`` and ``cleaned_answer``, by rules or by a model."""
    if make_client is None:
        return df.withColumn("rewritten_body", R.rewrite_body(F.col("body"))).withColumn(
            "cleaned_answer", R.rewrite_answer(F.col("answer"))
        )
    prompts = {
        "rewritten_body": render_prompt(body_prompt, {"body": F.col("body")}),
        "cleaned_answer": render_prompt(answer_prompt, {"answer": F.col("answer")}),
    }
    return batch_complete(df, prompts, make_client).withColumn(
        "cleaned_answer", strip_prefixes(F.col("cleaned_answer"))
    )


def curate_tickets(
    raw: DataFrame,
    id_column: str,
    n_limit: int | None = V.CURATED_SAMPLE,
    make_client: Callable[[], Client] | None = None,
) -> DataFrame:
    """The curated table from the raw one: columns, lengths, copies, sample, rewritten texts."""
    cleaned = filter_min_length(select_columns_by_rule(raw), ["body", "answer"])
    unique = dedup_exact(cleaned, ["body", "answer"], [id_column])
    chosen = sample_n(unique, n_limit, id_column) if n_limit else unique
    return rewrite_tickets(chosen, make_client)


def by_language(
    templates: Mapping[str, str],
    holes: Mapping[str, Column],
    defaults: Mapping[str, str] | None = None,
) -> Column:
    """The English template for ``en``, the German one for every other language."""
    return F.when(
        F.col("language") == "en", render_prompt_format(templates["en"], holes, defaults)
    ).otherwise(render_prompt_format(templates["de"], holes, defaults))


def _classify_prompt(text: str) -> Column:
    return by_language(P.CLASSIFY, {"issue_description": F.col(text)})


def _priority_prompt(text: str) -> Column:
    return by_language(P.PRIORITY, {"issue_description": F.col(text)})


def classify_topic_intent(
    df: DataFrame, make_client: Callable[[], Client] | None = None, text: str = "issue_description"
) -> DataFrame:
    """Add topic, intent and ``topic_error``; unreadable model answers give the defaults.

    ``topic_error`` says why a row has no answer of the model.
    """
    if make_client is None:
        return df.withColumns(
            {
                "topic": R.rule_topic(F.col(text)),
                "intent": R.rule_intent(F.col(text)),
                "topic_error": F.lit(None).cast("string"),
            }
        )
    found = parse_topic_intent(F.col("_raw"))
    return (
        batch_complete(df, {"_raw": _classify_prompt(text)}, make_client)
        .withColumns({"topic": found["topic"], "intent": found["intent"]})
        .withColumnRenamed("errors", "topic_error")
        .drop("_raw")
    )


def evaluate_priority(
    df: DataFrame, make_client: Callable[[], Client] | None = None, text: str = "issue_description"
) -> DataFrame:
    """Add priority_level, one of the four labels, and ``priority_error``."""
    if make_client is None:
        return df.withColumns(
            {
                "priority_level": R.rule_priority(F.col(text)),
                "priority_error": F.lit(None).cast("string"),
            }
        )
    return (
        batch_complete(df, {"_raw": _priority_prompt(text)}, make_client)
        .withColumn("priority_level", normalize_priority(F.col("_raw")))
        .withColumnRenamed("errors", "priority_error")
        .drop("_raw")
    )


def classify_answer_type(
    df: DataFrame, make_client: Callable[[], Client] | None = None
) -> DataFrame:
    """Add answer_type, whether it is one of the known words, and ``answer_type_error``."""
    if make_client is None:
        out = df.withColumns(
            {
                "answer_type": R.rule_answer_type(F.col("answer")),
                "answer_type_error": F.lit(None).cast("string"),
            }
        )
    else:
        prompt = render_prompt(
            P.ANSWER_TYPE, {"body": F.col("body"), "answer": F.col("answer")}
        )
        out = (
            batch_complete(df, {"_raw": prompt}, make_client)
            .withColumn("answer_type", normalize_label(F.col("_raw")))
            .withColumnRenamed("errors", "answer_type_error")
            .drop("_raw")
        )
    return out.withColumn("valid", F.col("answer_type").isin(V.ANSWER_TYPES))


def response_prompt(templates: Mapping[str, str] | None = None) -> Column:
    """The reply prompt of a ticket row in its language, with defaults for what is missing."""
    templates = templates or P.RESPONSE
    holes = {
        "priority_level": F.col("priority_level"),
        "topic": F.col("topic"),
        "intent": F.col("intent"),
        "issue_description": F.col("issue_description"),
        "context": join_context(F.col("retrieved_context")),
    }
    defaults = {
        "priority_level": V.DEFAULT_PRIORITY,
        "topic": V.DEFAULT_TOPIC,
        "intent": V.DEFAULT_INTENT,
    }
    return by_language(templates, holes, defaults)


def draft_response(
    df: DataFrame,
    make_client: Callable[[], Client] | None = None,
    templates: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``prompt``, ``final_response`` and ``response_error``.

    The rule answer is the best retrieved text. A failed call leaves an empty response.
    """
    with_prompt = df.withColumn("prompt", response_prompt(templates))
    if make_client is None:
        best = F.get("retrieved_context", F.lit(0))
        return with_prompt.withColumns(
            {
                "final_response": F.coalesce(F.trim(best), F.lit(V.NO_CONTEXT_MARK)),
                "response_error": F.lit(None).cast("string"),
            }
        )
    return (
        batch_complete(with_prompt, {"_raw": F.col("prompt")}, make_client)
        .withColumn("final_response", F.trim(F.coalesce("_raw", F.lit(""))))
        .withColumnRenamed("errors", "response_error")
        .drop("_raw")
    )


def understand_tickets(
    tickets: DataFrame, make_client: Callable[[], Client] | None = None
) -> DataFrame:
    """Language, topic, intent and priority of each ticket; with a model, one stage for both."""
    out = detect_language(tickets, "issue_description")
    if make_client is None:
        return evaluate_priority(classify_topic_intent(out))
    text = "issue_description"
    prompts = {"_topic": _classify_prompt(text), "_priority": _priority_prompt(text)}
    found = parse_topic_intent(F.col("_topic"))
    failed = F.col("errors")
    return (
        batch_complete(out, prompts, make_client)
        .withColumns(
            {
                "topic": found["topic"],
                "intent": found["intent"],
                "topic_error": F.when(F.col("_topic").isNull(), failed),
                "priority_level": normalize_priority(F.col("_priority")),
                "priority_error": F.when(F.col("_priority").isNull(), failed),
            }
        )
        .drop("_topic", "_priority", "errors")
    )


def respond(
    tickets: DataFrame, make_client: Callable[[], Client] | None = None
) -> DataFrame:
    """Draft the reply and apply the guardrails."""
    drafted = draft_response(tickets, make_client)
    return drafted.withColumn(
        "final_response",
        R.policy_guardrails(
            F.col("final_response"), F.col("priority_level"), F.size("retrieved_context") > 0
        ),
    )


def answer_tickets(
    tickets: DataFrame,
    articles: DataFrame,
    index: CellIndex | DataFrame | None = None,
    make_client: Callable[[], Client] | None = None,
    k: int = V.TOP_K,
    attributes: list[str] | None = None,
    recall: float = 0.95,
) -> DataFrame:
    """Understand, retrieve, draft and guard the replies to a whole table of tickets.

    ``tickets`` is (ticket_id, issue_description), ``articles`` (corpus_id, text). ``index`` is a cell
    index of the articles, or a stored index (corpus_id, embedding) to build one from; without one the
    articles are embedded here. With ``attributes`` the index has these columns, and a ticket meets the
    articles that equal it in all of them; ``language`` is the guessed one. A search finds at least
    ``recall`` of the k nearest articles of every ticket and compares the cells it has to. The rows go to
    the table of agent outputs through ``sinks.agent_output_rows``.
    """
    if not isinstance(index, CellIndex):
        index = build_cells(embed(articles, "text") if index is None else index, attributes)
    queries = embed(detect_language(tickets, "issue_description"), "issue_description")
    queries = queries.withColumnRenamed("ticket_id", "query_id")
    hits = index.search(queries, k, recall)
    chunks = retrieve_text_chunks(queries, hits, articles, "text").select(
        F.col("query_id").alias("ticket_id"), F.col("chunks").alias("retrieved_context")
    )
    return respond(understand_tickets(tickets, make_client).join(chunks, "ticket_id"), make_client)
