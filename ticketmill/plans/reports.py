"""Profiles of the tickets and reports over evaluation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..operators import profile as P
from ..operators.evaluate import rule_scores
from ..session import scratch_path
from . import frames as T
from .evaluation import SCORED
from .frames import with_sql
from .registry import query

PROFILED = ["language", "queue", "type", "priority"]
METRIC_SCORES = [f"{m}_score" for m in P.METRICS]
SCORES = [*METRIC_SCORES, "average_score"]


@query(
    "profile_counts",
    with_sql("tickets", "labelled_tickets")
    + " SELECT 'total' AS dimension, NULL::VARCHAR AS value, count(*) AS n FROM labelled_tickets"
    + "".join(
        f" UNION ALL SELECT '{c}', {c}, count(*) FROM labelled_tickets WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in PROFILED
    ),
)
def profile_counts(spark, tables):
    return P.profile_counts(T.labelled_tickets(spark, tables), PROFILED)


@query(
    "value_counts",
    with_sql("tickets")
    + " SELECT queue, count(*) AS n FROM tickets WHERE queue IS NOT NULL GROUP BY queue",
)
def value_counts(spark, tables):
    return P.value_counts(T.tickets(spark, tables), "queue")


@query(
    "profile_nulls",
    with_sql("tickets", "labelled_tickets")
    + " SELECT "
    + ", ".join(
        f"count(*) FILTER ({c} IS NULL) AS {c}_nulls"
        for c in ["subject", "body", "answer", "type", "queue", "priority", "language"]
    )
    + " FROM labelled_tickets",
)
def profile_nulls(spark, tables):
    return P.profile_nulls(
        T.labelled_tickets(spark, tables).select(
            "subject", "body", "answer", "type", "queue", "priority", "language"
        )
    )


@query(
    "profile_lengths",
    with_sql("tickets")
    + ", lengths AS (SELECT 'body' AS column, length(body) AS len FROM tickets"
    + " UNION ALL SELECT 'answer', length(answer) FROM tickets)"
    + """ SELECT "column", round(avg(len), 6) AS mean_length, median(len) AS median_length,
           min(len)::INTEGER AS min_length, max(len)::INTEGER AS max_length
    FROM lengths WHERE len IS NOT NULL GROUP BY "column" """,
)
def profile_lengths(spark, tables):
    return P.profile_lengths(T.tickets(spark, tables), ["body", "answer"])


@query(
    "profile_from_sketches",
    with_sql("tickets")
    + ", cells AS (SELECT 'body' AS column, body AS text FROM tickets"
    + " UNION ALL SELECT 'answer', answer FROM tickets"
    + " UNION ALL SELECT 'subject', subject FROM tickets)"
    + """ SELECT "column", count(*) AS n, count(*) - count(text) AS nulls,
           min(length(text)) AS shortest, max(length(text)) AS longest,
           true AS distinct_near, true AS median_near FROM cells GROUP BY "column" """,
)
def profile_from_sketches(spark, tables):
    """Two loads sketched and stored; the profile of both reads the sketches and no texts.

    The estimates are held against exact counts: 5 % of the distinct values, 5 % of the ranks.
    """
    tickets = T.tickets(spark, tables)
    columns = ["body", "answer", "subject"]
    path = scratch_path(spark, "sketches")
    for load in (F.col("ticket_id") % 3 == 0, F.col("ticket_id") % 3 != 0):
        P.sketch_load(tickets.filter(load), columns).write.mode("append").parquet(path)
    profile = P.profile_from_sketches(spark.read.parquet(path))
    cells = tickets.unpivot("ticket_id", columns, "column", "text").withColumn("size", F.length("text"))
    exact = cells.join(profile.select("column", "median"), "column").groupBy("column").agg(
        F.countDistinct("text").alias("exact"),
        F.count_if(F.col("size") < F.col("median")).alias("below"),
        F.count_if(F.col("size") <= F.col("median")).alias("upto"),
        F.count("size").alias("sized"),
    )
    near = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")
    middle = (F.col("below") <= 0.55 * F.col("sized")) & (F.col("upto") >= 0.45 * F.col("sized"))
    return profile.join(exact, "column").select(
        "column", "n", "nulls", "shortest", "longest",
        near.alias("distinct_near"), middle.alias("median_near"),
    )


@query(
    "count_distinct",
    with_sql("tickets", "labelled_tickets")
    + """ SELECT *, n_type * n_priority * n_language AS n_product FROM (
        SELECT count(DISTINCT type) AS n_type, count(DISTINCT priority) AS n_priority,
               count(DISTINCT language) AS n_language FROM labelled_tickets)""",
)
def count_distinct(spark, tables):
    return P.count_distinct(T.labelled_tickets(spark, tables), ["type", "priority", "language"])


@query(
    "group_mean",
    SCORED
    + """ SELECT language, round(avg(average_score), 6) AS mean_average_score,
           round(avg(total_input_tokens), 6) AS mean_total_input_tokens
    FROM scored WHERE language IS NOT NULL GROUP BY language""",
)
def group_mean(spark, tables):
    results = rule_scores(T.runs(spark, tables))
    return P.group_mean(results, "language", ["average_score", "total_input_tokens"])


@query(
    "group_stats",
    with_sql("records", "feedback")
    + f""" SELECT feedback_name, count(*) AS count, round(avg(result), 6) AS avg_score,
           min(result) AS min_score, max(result) AS max_score,
           round(stddev_samp(result), 6) AS std_dev
    FROM feedback WHERE record_id IN (SELECT record_id FROM records WHERE tags = '{T.RUN}')
    GROUP BY feedback_name""",
)
def group_stats(spark, tables):
    from ..operators.relate import feedback_of_run

    rows = feedback_of_run(T.feedback(spark, tables), T.records(spark, tables), T.RUN)
    return P.group_stats(rows, "feedback_name", "result")


@query(
    "group_having_max",
    with_sql("snapshots")
    + """ SELECT thread_id, count(*) AS copies, max(ingested_at) AS keep_at FROM snapshots
    GROUP BY thread_id HAVING count(*) > 1""",
)
def group_having_max(spark, tables):
    return C.newest_per_key(T.snapshots(spark, tables), ["thread_id"])


@query(
    "count_where",
    with_sql("records") + f" SELECT count(*) AS cnt FROM records WHERE tags = '{T.RUN}'",
)
def count_where(spark, tables):
    return T.records(spark, tables).filter(F.col("tags") == T.RUN).agg(F.count("*").alias("cnt"))


@query(
    "pivot_first",
    with_sql("records", "feedback")
    + """ SELECT record_id, input, min(result) FILTER (feedback_name = 'quality') AS quality,
           min(result) FILTER (feedback_name = 'toxic') AS toxic
    FROM records JOIN feedback USING (record_id) GROUP BY record_id, input""",
)
def pivot_first(spark, tables):
    rows = T.records(spark, tables).join(T.feedback(spark, tables), "record_id")
    return P.pivot_first(
        rows, ["record_id", "input"], "feedback_name", ["quality", "toxic"], "result", "result"
    )


@query(
    "average_score",
    SCORED + " SELECT ticket_id, round(average_score, 6) AS average_score FROM scored",
)
def average_score(spark, tables):
    scored = rule_scores(T.runs(spark, tables))
    return scored.select("ticket_id", F.round(P.average_score(), 6).alias("average_score"))


@query(
    "exchange_count",
    """SELECT conv_id, count(*) // 2 AS exchanges FROM conversations
    WHERE role IN ('user', 'assistant') GROUP BY conv_id""",
)
def exchange_count(spark, tables):
    from ..operators.state import exchange_count as count

    return count(T.scan(spark, tables, "conversations"))


def _means(columns: list[str]) -> str:
    return ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in columns)


def _breakdown_sql(groups: list[str], columns: list[str]) -> str:
    parts = [
        f"SELECT '{g}' AS dimension, {g} AS value, count(*) AS n_tickets, {_means(columns)}"
        f" FROM scored WHERE {g} IS NOT NULL GROUP BY {g}"
        for g in groups
    ]
    parts.append(f"SELECT 'overall', NULL, count(*), {_means(columns)} FROM scored")
    return " UNION ALL ".join(parts)


@query("eval_summary", SCORED + f" SELECT count(*) AS n_tickets, {_means(SCORES)} FROM scored")
def eval_summary(spark, tables):
    return P.eval_summary(rule_scores(T.runs(spark, tables)), SCORES)


GROUPS = ["language", "queue", "priority"]


@query("eval_breakdown", f"{SCORED} {_breakdown_sql(GROUPS, SCORES)}")
def eval_breakdown(spark, tables):
    return P.eval_breakdown(rule_scores(T.runs(spark, tables)), GROUPS, SCORES)


@query(
    "usage_summary",
    with_sql("pairs", "runs")
    + ", scored AS (SELECT *, used_search::INTEGER AS used_search_share FROM runs) "
    + _breakdown_sql(
        ["language", "priority"],
        ["total_input_tokens", "total_output_tokens", "used_search_share"],
    ),
)
def usage_summary(spark, tables):
    return P.usage_summary(T.runs(spark, tables), ["language", "priority"])


@query(
    "weakest_groups",
    f"{SCORED}, breakdown AS ({_breakdown_sql(GROUPS, ['average_score'])})"
    + """ SELECT * FROM breakdown WHERE dimension <> 'overall'
    ORDER BY mean_average_score, dimension, value LIMIT 5""",
)
def weakest_groups(spark, tables):
    breakdown = P.eval_breakdown(rule_scores(T.runs(spark, tables)), GROUPS, ["average_score"])
    return P.weakest_groups(breakdown, "mean_average_score", 5)


@query(
    "sanity_scores",
    SCORED
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(min({m}_score), 6) AS min_score,
        round(max({m}_score), 6) AS max_score,
        min({m}_score) = max({m}_score) AND min({m}_score) IN (0, 1) AS suspicious FROM scored"""
        for m in P.METRICS
    ),
)
def sanity_scores(spark, tables):
    return P.sanity_scores(rule_scores(T.runs(spark, tables)))
