"""Scores of answers, judged batches, agreement with labels."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import evaluate as E
from ..operators import rules as R
from ..operators.profile import METRICS
from ..sources.sinks import append_table, ensure_database
from ..session import scratch_path
from . import frames as T
from .frames import sql_text, sql_words, with_sql
from .registry import query


def _found_share_sql(needles: str, haystack: str) -> str:
    wanted = f"list_distinct({needles})"
    return (
        f"CASE WHEN len({wanted}) = 0 THEN 0.0::DOUBLE"
        f" ELSE len(list_intersect({wanted}, {haystack}))::DOUBLE / len({wanted}) END"
    )


def _backed_sql(text: str, source: str) -> str:
    """Share of a text's sentences that are backed, through a list of sentence word lists."""
    claims = (
        f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?\\n]+'),"
        f" lambda s: {sql_words('s')}), lambda w: len(w) > 0)"
    )
    backed = f"list_filter({claims}, lambda w: {_found_share_sql('w', source)} >= {E.CLAIM_SHARE})"
    return (
        f"CASE WHEN len({claims}) = 0 THEN 0.0::DOUBLE"
        f" ELSE len({backed})::DOUBLE / len({claims}) END"
    )


def _precision_sql() -> str:
    chunks = (
        "list_filter(list_transform(string_split(context, chr(10) || chr(10)),"
        f" lambda c: {sql_words('c')}), lambda w: len(w) > 0)"
    )
    useful = f"list_filter({chunks}, lambda w: {_found_share_sql('qw', 'w')} >= {E.CHUNK_SHARE})"
    return (
        f"CASE WHEN len({chunks}) = 0 THEN 0.0::DOUBLE"
        f" ELSE len({useful})::DOUBLE / len({chunks}) END"
    )


SCORED = (
    with_sql("pairs", "runs")
    + f""", worded AS (
    SELECT *, {sql_words('context')} AS cw, {sql_words('query')} AS qw,
           {sql_words('agent_answer')} AS aw FROM runs), metrics AS (
    SELECT * EXCLUDE (cw, qw, aw),
           {_backed_sql('agent_answer', 'cw')} AS faithfulness_score,
           {_found_share_sql('qw', 'aw')} AS answer_relevancy_score,
           {_precision_sql()} AS context_precision_score,
           {_backed_sql('ground_truth', 'cw')} AS context_recall_score
    FROM worded), scored AS (
    SELECT *, (faithfulness_score + answer_relevancy_score + context_precision_score
               + context_recall_score) / 4 AS average_score FROM metrics)"""
)


def _register_metric(metric: str) -> None:
    column = f"{metric}_score"

    @query(
        f"metric_{metric}",
        SCORED + f" SELECT ticket_id, round({column}, 6) AS {column} FROM scored",
    )
    def run(spark, tables):
        scored = E.rule_scores(T.runs(spark, tables))
        return scored.select("ticket_id", F.round(column, 6).alias(column))


for _metric in METRICS:
    _register_metric(_metric)


def length_judge():
    """A judging client without a model: the score follows from the length of the prompt."""

    def judge(prompts: list[str]) -> list[str]:
        answers = []
        for prompt in prompts:
            body = json.dumps({"score": len(prompt) % 101 / 100, "explanation": "by length"})
            answers.append(body if len(prompt) % 2 else f"```json\n{body}\n```")
        return answers

    return judge


def _judge_prompt_sql(metric: str) -> str:
    template, holes = E.JUDGE_TEMPLATES[metric]
    out = sql_text(template)
    for hole in holes:
        out = f"replace({out}, '{{{hole}}}', {'agent_answer' if hole == 'answer' else hole})"
    return out


@query(
    "score_batch",
    with_sql("pairs", "runs")
    + ", judged AS (SELECT ticket_id, "
    + ", ".join(
        f"(length({_judge_prompt_sql(m)}) % 101)::DOUBLE / 100 AS {m}_score" for m in METRICS
    )
    + " FROM runs) SELECT ticket_id, "
    + ", ".join(
        f"round({m}_score, 6) AS {m}_score, 'by length' AS {m}_explanation, true AS {m}_parse_ok"
        for m in METRICS
    )
    + ", NULL::VARCHAR AS judge_error"
    + ", round(("
    + " + ".join(f"{m}_score" for m in METRICS)
    + ") / 4, 6) AS average_score FROM judged",
)
def score_batch(spark, tables):
    rows = T.runs(spark, tables).select(
        "ticket_id", "query", "ground_truth", "agent_answer", "context"
    )
    scored = E.score_batch(rows, length_judge)
    out = [F.col("ticket_id")]
    for m in METRICS:
        out += [F.round(f"{m}_score", 6).alias(f"{m}_score"), f"{m}_explanation", f"{m}_parse_ok"]
    return scored.select(*out, F.round("average_score", 6).alias("average_score"), "judge_error")


def tired_judge():
    """Fails on prompts with two exclamation marks and gives no JSON for those with a bar."""

    def judge(prompts: list[str]) -> list[str]:
        if any("!!" in p for p in prompts):
            raise TimeoutError("no answer")
        return ["unsure" if "|" in p else '{"score": 1, "explanation": ""}' for p in prompts]

    return judge


@query(
    "score_failures",
    with_sql("pairs", "runs")
    + f""", judged AS (SELECT ticket_id, {_judge_prompt_sql("faithfulness")} AS prompt FROM runs)
    SELECT ticket_id, contains(prompt, '!!') AS failed,
           NOT contains(prompt, '!!') AND NOT contains(prompt, '|') AS faithfulness_parse_ok,
           CASE WHEN NOT contains(prompt, '!!') AND contains(prompt, '|') THEN 'unsure' END
               AS faithfulness_error
    FROM judged""",
)
def score_failures(spark, tables):
    """What is left of rows whose judge fails or answers in prose: the score's error, per row."""
    rows = T.runs(spark, tables).select(
        "ticket_id", "query", "ground_truth", "agent_answer", "context"
    )
    scored = E.score_batch(rows, tired_judge)
    lost = F.col("faithfulness_explanation") == V.INVALID_RESPONSE
    return scored.select(
        "ticket_id", lost.alias("failed"), "faithfulness_parse_ok", "faithfulness_error"
    )


def echo_agent():
    """An agent without a model: it finds the query itself and answers it in small letters."""

    def answer(queries: list[str]) -> list[str]:
        responses = []
        for text in queries:
            found = {"name": V.SEARCH_TOOL, "status": "success", "content": text}
            tokens = {
                "model_name": "echo",
                "input_tokens": {"total": len(text)},
                "output_tokens": {"total": len(text) * 2},
            }
            steps = [
                {"type": "tool_use", "tool_use": {"name": V.SEARCH_TOOL, "input": "q"}},
                {"type": "tool_result", "tool_result": found},
                {"type": "text", "text": text.lower()},
            ]
            usage = {"usage": {"tokens_consumed": [tokens]}}
            responses.append(json.dumps({"content": steps, "metadata": usage}))
        return responses

    return answer


@query(
    "run_batch_evaluation",
    with_sql("pairs")
    + """, runs AS (
        SELECT ticket_id, body AS query, answer AS ground_truth, trim(lower(body)) AS agent_answer,
               body AS context FROM answered), judged AS (SELECT *, """
    + ", ".join(
        f"(length({_judge_prompt_sql(m)}) % 101)::DOUBLE / 100 AS {m}_score" for m in METRICS
    )
    + """ FROM runs) SELECT ticket_id, 'N/A' AS language, query, agent_answer, context,
           true AS used_search, 'echo' AS agent_model, length(query) AS total_input_tokens,
           length(query) * 2 AS total_output_tokens, round(("""
    + " + ".join(f"{m}_score" for m in METRICS)
    + ") / 4, 6) AS average_score FROM judged",
)
def run_batch_evaluation(spark, tables):
    testset = T.answered_tickets(spark, tables).select(
        "ticket_id", F.col("body").alias("rewritten_body"), F.col("answer").alias("cleaned_answer")
    )
    return E.run_batch_evaluation(testset, echo_agent, length_judge).select(
        "ticket_id", "language", "query", "agent_answer", "context", "used_search", "agent_model",
        "total_input_tokens", "total_output_tokens",
        F.round("average_score", 6).alias("average_score"),
    )


@query(
    "split_label_output",
    with_sql("pairs", "runs")
    + """ SELECT ticket_id, language, priority, 'N/A' AS type, query, ground_truth, agent_answer,
           context, used_search, 'rules' AS agent_model, total_input_tokens, total_output_tokens
    FROM runs""",
)
def split_label_output(spark, tables):
    from ..operators.curate import default_missing_column

    results = default_missing_column(T.runs(spark, tables), "type")
    return results.select(
        "ticket_id",
        "language",
        "priority",
        "type",
        "query",
        "ground_truth",
        "agent_answer",
        "context",
        "used_search",
        F.lit("rules").alias("agent_model"),
        "total_input_tokens",
        "total_output_tokens",
    )


@query(
    "eval_runs",
    with_sql("pairs", "runs")
    + """ SELECT 'run-1' AS run_id, 'abc123' AS commit_sha, 'rules' AS model,
           TIMESTAMP '2024-01-31 00:00:00' AS date, ticket_id, used_search FROM runs""",
)
def eval_runs(spark, tables):
    path = scratch_path(spark, "runs")
    database = f"eval_{path.rsplit('-', 1)[1]}"
    ensure_database(spark, database, path)
    append_table(
        E.run_row(spark, "run-1", "abc123", "rules", "2024-01-31 00:00:00"), f"{database}.runs"
    )
    results = E.with_run(T.runs(spark, tables).select("ticket_id", "used_search"), "run-1")
    append_table(results, f"{database}.results")
    return spark.table(f"{database}.runs").join(spark.table(f"{database}.results"), "run_id").select(
        "run_id", "commit_sha", "model", "date", "ticket_id", "used_search"
    )


def keyword_sql(text: str, table: list[tuple[str, list[str]]], default: str) -> str:
    """The keyword rules as a CASE expression."""
    cases = [
        "WHEN "
        + " OR ".join(f"contains(lower({text}), {sql_text(k)})" for k in keywords)
        + f" THEN '{label}'"
        for label, keywords in table
    ]
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


@query(
    "priority_accuracy",
    f"""WITH scored AS (
        SELECT CASE WHEN upper(o_orderpriority) LIKE '%URG%' THEN 'URGENT'
                    WHEN upper(o_orderpriority) LIKE '%HIGH%' THEN 'HIGH'
                    WHEN upper(o_orderpriority) LIKE '%MED%' THEN 'MEDIUM' ELSE 'LOW' END AS label,
               {keyword_sql('text', R.PRIORITY_KEYWORDS, 'LOW')} AS predicted
        FROM documents JOIN orders ON o_orderkey = doc_id)
    SELECT label, predicted, count(*) AS n,
           (SELECT round(avg((label = predicted)::INTEGER), 6) FROM scored) AS accuracy
    FROM scored GROUP BY label, predicted""",
)
def priority_accuracy(spark, tables):
    from ..functions.text import normalize_priority

    orders = T.scan(spark, tables, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        normalize_priority(F.col("o_orderpriority")).alias("label"),
    )
    predicted = T.scan(spark, tables, "documents").select(
        "doc_id", R.rule_priority(F.col("text")).alias("predicted")
    )
    return E.priority_accuracy(predicted.join(orders, "doc_id"), "label", "predicted")


@query(
    "classifier_validation",
    """WITH judged AS (
        SELECT quality AS label, (length(text) >= 50)::INTEGER AS predicted
        FROM labels JOIN documents USING (doc_id))
    SELECT count(*) AS n, round(avg((label = predicted)::INTEGER), 6) AS agreement,
           avg((label = predicted)::INTEGER) >= 0.8 AS passed FROM judged""",
)
def classifier_validation(spark, tables):
    rule = T.scan(spark, tables, "documents").select(
        "doc_id", (F.length("text") >= V.MIN_TEXT_LENGTH).cast("int").alias("predicted")
    )
    labels = T.scan(spark, tables, "labels").select("doc_id", F.col("quality").alias("label"))
    return E.classifier_validation(rule.join(labels, "doc_id"), "label", "predicted")
