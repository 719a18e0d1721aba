"""Joins, unions and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import curate as C
from ..operators import relate as R
from . import frames as T
from .frames import with_sql
from .registry import query


@query(
    "join_left_feedback",
    with_sql("records", "feedback")
    + f""" SELECT r.record_id, input, tags, feedback_name, result
    FROM records r LEFT JOIN feedback f ON r.record_id = f.record_id WHERE tags = '{T.RUN}'""",
)
def join_left_feedback(spark, tables):
    return R.records_with_feedback(T.records(spark, tables), T.feedback(spark, tables), T.RUN)


@query(
    "join_semi_in",
    with_sql("records", "feedback")
    + f""" SELECT * FROM feedback
    WHERE record_id IN (SELECT record_id FROM records WHERE tags = '{T.RUN}')""",
)
def join_semi_in(spark, tables):
    return R.feedback_of_run(T.feedback(spark, tables), T.records(spark, tables), T.RUN)


@query(
    "join_delete_using",
    with_sql("snapshots")
    + """, newest AS (SELECT thread_id, max(ingested_at) AS keep_at FROM snapshots
                      GROUP BY thread_id HAVING count(*) > 1)
    SELECT s.* FROM snapshots s
    WHERE NOT EXISTS (SELECT 1 FROM newest n
                      WHERE n.thread_id = s.thread_id AND s.ingested_at < n.keep_at)""",
)
def join_delete_using(spark, tables):
    rows = T.snapshots(spark, tables)
    return C.delete_older(rows, C.newest_per_key(rows, ["thread_id"]), ["thread_id"])


CURRENT = """, listing AS (SELECT conversation_id, thread_id, updated_at FROM state),
    current AS (SELECT DISTINCT conv_id::VARCHAR AS conversation_id FROM conversations),
    missing AS (SELECT conversation_id FROM current
                WHERE conversation_id NOT IN (SELECT conversation_id FROM listing)),
    merged AS (SELECT conversation_id, NULL::BIGINT AS thread_id, NULL::TIMESTAMP AS updated_at,
                      0 AS position FROM missing
               UNION ALL SELECT *, 1 FROM listing)"""


def _current(spark, tables):
    state = T.conversations(T.conversation_updates(spark, tables))
    listing = state.select("conversation_id", "thread_id", "updated_at")
    current = T.scan(spark, tables, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id")
    ).distinct()
    return R.with_current_conversation(listing, current, "conversation_id")


@query("join_current_conversation", with_sql("updates", "state") + CURRENT + " SELECT * FROM merged")
def join_current_conversation(spark, tables):
    return _current(spark, tables)


@query(
    "union_prepend",
    with_sql("updates", "state")
    + CURRENT
    + " SELECT position, count(*) AS n, count(thread_id) AS with_thread FROM merged GROUP BY position",
)
def union_prepend(spark, tables):
    return _current(spark, tables).groupBy("position").agg(
        F.count("*").alias("n"), F.count("thread_id").alias("with_thread")
    )


@query(
    "join_fallback_output",
    f"""SELECT doc_id AS ticket_id,
           CASE WHEN l.doc_id IS NULL THEN '{V.DEFAULT_PRIORITY}'
                WHEN toxic = 1 THEN 'HIGH' ELSE 'LOW' END AS priority_level,
           CASE WHEN l.doc_id IS NULL THEN '{V.FALLBACK_LABEL}' ELSE 'bug' END AS topic,
           CASE WHEN l.doc_id IS NULL THEN '{V.FALLBACK_LABEL}' ELSE 'request' END AS intent,
           CASE WHEN l.doc_id IS NULL THEN 0 ELSE quality END AS n_chunks
    FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def join_fallback_output(spark, tables):
    chunk = F.array_repeat(F.lit("chunk"), F.col("quality"))
    outputs = T.scan(spark, tables, "labels").select(
        F.col("doc_id").alias("ticket_id"),
        F.when(F.col("toxic") == 1, "HIGH").otherwise("LOW").alias("priority_level"),
        F.lit("bug").alias("topic"),
        F.lit("request").alias("intent"),
        chunk.alias("retrieved_context"),
    )
    asked = T.scan(spark, tables, "documents").select(F.col("doc_id").alias("ticket_id"))
    return R.with_fallback_output(asked, outputs, "ticket_id").select(
        "ticket_id", "priority_level", "topic", "intent", F.size("retrieved_context").alias("n_chunks")
    )


@query(
    "join_answer_ground_truth",
    with_sql("pairs")
    + """ SELECT ticket_id, body AS query, answer AS ground_truth, lang AS language,
           text AS agent_answer FROM answered JOIN documents ON doc_id = conv_id""",
)
def join_answer_ground_truth(spark, tables):
    testset = T.answered_tickets(spark, tables).select(
        "ticket_id", "conv_id", F.col("body").alias("query"), F.col("answer").alias("ground_truth")
    )
    answers = T.scan(spark, tables, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("lang").alias("language"), F.col("text").alias("agent_answer")
    )
    by_ticket = testset.select("ticket_id", "conv_id").join(answers, "conv_id").drop("conv_id")
    return R.answers_with_ground_truth(by_ticket, testset.drop("conv_id")).select(
        "ticket_id", "query", "ground_truth", "language", "agent_answer"
    )


@query(
    "join_qa_pairs",
    with_sql("pairs") + " SELECT conv_id, turn, answer_turn, body, answer FROM answered",
)
def join_qa_pairs(spark, tables):
    return R.qa_pairs(T.messages(spark, tables))


DISTINCT_TAGS = with_sql("parts") + " " + " UNION ".join(
    f"SELECT {c} AS tag FROM parts WHERE {c} IS NOT NULL" for c in T.TAGS
)


@query("distinct_tags", DISTINCT_TAGS)
def distinct_tags(spark, tables):
    return R.distinct_tags(T.parts_as_tags(spark, tables), T.TAGS)


@query("union_tags", DISTINCT_TAGS)
def union_tags(spark, tables):
    return R.union_tags(T.parts_as_tags(spark, tables), T.TAGS)
