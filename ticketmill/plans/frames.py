"""The given tables in the shapes the operators expect, as frames and as SQL.

Every frame has a SQL twin of the same name in ``SQL``, a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import WORD_GAP, words
from ..operators.relate import qa_pairs
from ..operators.state import latest_per_key
from ..sources.readers import scan_table

RUN = "en"
SPLIT_AT = "2024-01-16 00:00:00"


def scan(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return scan_table(spark, f"{tables}/{name}.parquet")


def tickets(spark: SparkSession, tables: str) -> DataFrame:
    """Documents as tickets: the first line is the body, all further lines are the answer."""
    at = F.instr("text", "\n")
    return scan(spark, tables, "documents").select(
        F.col("doc_id").alias("ticket_id"),
        F.concat_ws(" ", "source", "lang").alias("subject"),
        F.substring_index("text", "\n", 1).alias("body"),
        F.when(at > 0, F.substr(F.col("text"), at + 1)).alias("answer"),
        F.col("source").alias("queue"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("version"),
        F.col("source").alias("tag_1"),
        F.col("lang").alias("tag_2"),
        F.upper("lang").alias("tag_3"),
    )


def labelled_tickets(spark: SparkSession, tables: str) -> DataFrame:
    """Tickets with type and priority, taken from the order with the ticket's number."""
    orders = scan(spark, tables, "orders").select(
        F.col("o_orderkey").alias("ticket_id"),
        F.when(F.col("o_orderstatus") == "F", "Incident")
        .when(F.col("o_orderstatus") == "O", "Request")
        .otherwise("Problem")
        .alias("type"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("priority"),
    )
    return tickets(spark, tables).join(orders, "ticket_id")


def messages(spark: SparkSession, tables: str) -> DataFrame:
    """Conversations with a message id per turn, counted from 1."""
    return scan(spark, tables, "conversations").withColumn("message_id", F.col("turn") + 1)


def conversation_updates(spark: SparkSession, tables: str) -> DataFrame:
    return as_conversation_updates(scan(spark, tables, "events"))


def as_conversation_updates(events: DataFrame) -> DataFrame:
    """Events as updates of a conversation per user; errors reset the last answer to null."""
    return events.select(
        F.col("user_id").cast("string").alias("conversation_id"),
        (F.col("user_id") + 1000).alias("thread_id"),
        F.when(F.col("event_type") != "error", F.col("event_id")).alias(
            "last_assistant_message_id"
        ),
        F.col("event_type").alias("origin_application"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )


def conversations(updates: DataFrame) -> DataFrame:
    """The conversations table that the given updates lead to."""
    order = ["updated_at", "event_id"]
    latest = latest_per_key(updates, "conversation_id", order, {"created_at": "updated_at"})
    return latest.drop("event_id")


def snapshots(spark: SparkSession, tables: str) -> DataFrame:
    """Events as snapshots of a thread per user, taken once a day, so that newest ones tie."""
    return scan(spark, tables, "events").select(
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("message_id"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ingested_at"),
        "event_type",
    )


def records(spark: SparkSession, tables: str) -> DataFrame:
    return scan(spark, tables, "documents").select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("input"), F.col("lang").alias("tags")
    )


def feedback(spark: SparkSession, tables: str) -> DataFrame:
    """Labels as one row per record and feedback name."""
    return (
        scan(spark, tables, "labels")
        .unpivot("doc_id", ["quality", "toxic"], "feedback_name", "result")
        .select(
            F.col("doc_id").alias("record_id"),
            "feedback_name",
            F.col("result").cast("double").alias("result"),
        )
    )


def answered_tickets(spark: SparkSession, tables: str) -> DataFrame:
    """Question and answer pairs of the conversations under one id."""
    pairs = qa_pairs(messages(spark, tables))
    return pairs.withColumn("ticket_id", F.concat_ws("-", "conv_id", "turn"))


def runs(spark: SparkSession, tables: str) -> DataFrame:
    """Answered tickets with the attributes and context an agent run leaves behind.

    The document with the conversation's number serves as context, one chunk per line. The agent's
    answer is the expected answer followed by the context.
    """
    found = F.col("text").isNotNull()
    context = F.when(found, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(V.NO_CONTEXT)
    docs = scan(spark, tables, "documents").select(
        F.col("doc_id").alias("conv_id"), "text", "lang", "source"
    )
    orders = scan(spark, tables, "orders").select(
        F.col("o_orderkey").alias("conv_id"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("priority"),
    )
    return (
        answered_tickets(spark, tables)
        .join(docs, "conv_id", "left")
        .join(orders, "conv_id", "left")
        .select(
            "ticket_id",
            F.col("lang").alias("language"),
            F.col("source").alias("queue"),
            "priority",
            F.col("body").alias("query"),
            F.col("answer").alias("ground_truth"),
            F.concat_ws("\n", "answer", "text").alias("agent_answer"),
            context.alias("context"),
            found.alias("used_search"),
        )
        .withColumn("total_input_tokens", F.size(words(F.col("context"))).cast("bigint"))
        .withColumn("total_output_tokens", F.size(words(F.col("agent_answer"))).cast("bigint"))
    )


def parts_as_tags(spark: SparkSession, tables: str) -> DataFrame:
    """Parts as tickets with sparse tags."""
    name = F.split("p_name", " ")
    return scan(spark, tables, "part").select(
        F.col("p_brand").alias("tag_1"),
        F.col("p_type").alias("tag_2"),
        F.get(name, F.lit(0)).alias("tag_3"),
        F.get(name, F.lit(1)).alias("tag_4"),
    )


TAGS = ["tag_1", "tag_2", "tag_3", "tag_4"]


# --- SQL twins -----------------------------------------------------------------------------------


def sql_text(value: str) -> str:
    """A text as SQL literal, line ends kept."""
    return "'" + value.replace("'", "''") + "'"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WORD_GAP}'), lambda x: x <> '')"


def sql_strip(text: str) -> str:
    return f"trim({text}, {sql_text(V.STRIP_CHARS)})"


SQL = {
    "tickets": """tickets AS (
    SELECT doc_id AS ticket_id, source || ' ' || lang AS subject,
           split_part(text, chr(10), 1) AS body,
           CASE WHEN strpos(text, chr(10)) > 0
                THEN substr(text, strpos(text, chr(10)) + 1) END AS answer,
           source AS queue, lang AS language, n_chars AS version,
           source AS tag_1, lang AS tag_2, upper(lang) AS tag_3
    FROM documents)""",
    "labelled_tickets": """labelled_tickets AS (
    SELECT t.*,
           CASE o_orderstatus WHEN 'F' THEN 'Incident' WHEN 'O' THEN 'Request'
                ELSE 'Problem' END AS type,
           lower(substr(o_orderpriority, 3)) AS priority
    FROM tickets t JOIN orders ON o_orderkey = ticket_id)""",
    "messages": "messages AS (SELECT *, turn + 1 AS message_id FROM conversations)",
    "updates": """updates AS (
    SELECT user_id::VARCHAR AS conversation_id, user_id + 1000 AS thread_id,
           CASE WHEN event_type <> 'error' THEN event_id END AS last_assistant_message_id,
           event_type AS origin_application, ts AS updated_at, event_id
    FROM events)""",
    "state": """state AS (
    SELECT conversation_id, thread_id, last_assistant_message_id, origin_application,
           created_at, updated_at
    FROM (SELECT *, min(updated_at) OVER (PARTITION BY conversation_id) AS created_at,
                 row_number() OVER (PARTITION BY conversation_id
                                    ORDER BY updated_at DESC, event_id DESC) AS rn
          FROM updates) WHERE rn = 1)""",
    "snapshots": """snapshots AS (
    SELECT user_id AS thread_id, event_id AS message_id,
           date_trunc('day', ts)::TIMESTAMP AS ingested_at, event_type
    FROM events)""",
    "records": """records AS (
    SELECT doc_id AS record_id, source AS input, lang AS tags FROM documents)""",
    "feedback": """feedback AS (
    SELECT doc_id AS record_id, 'quality' AS feedback_name, quality::DOUBLE AS result FROM labels
    UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels)""",
    "pairs": """pairs AS (
    SELECT u.conv_id, u.turn, min(a.turn) AS answer_turn
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn > u.turn AND a.role = 'assistant'
    WHERE u.role = 'user' GROUP BY ALL),
answered AS (
    SELECT p.conv_id || '-' || p.turn AS ticket_id, p.*, u.text AS body, a.text AS answer
    FROM pairs p JOIN conversations u ON u.conv_id = p.conv_id AND u.turn = p.turn
                 JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = p.answer_turn)""",
    "runs": f"""runs AS (
    SELECT *, len({sql_words('context')}) AS total_input_tokens,
           len({sql_words('agent_answer')}) AS total_output_tokens
    FROM (SELECT ticket_id, lang AS language, source AS queue,
                 lower(substr(o_orderpriority, 3)) AS priority,
                 body AS query, answer AS ground_truth,
                 concat_ws(chr(10), answer, d.text) AS agent_answer,
                 coalesce(replace(d.text, chr(10), chr(10) || chr(10)), '{V.NO_CONTEXT}') AS context,
                 d.text IS NOT NULL AS used_search
          FROM answered LEFT JOIN documents d ON doc_id = conv_id
                        LEFT JOIN orders ON o_orderkey = conv_id))""",
    "parts": """parts AS (
    SELECT p_brand AS tag_1, p_type AS tag_2, split_part(p_name, ' ', 1) AS tag_3,
           nullif(split_part(p_name, ' ', 2), '') AS tag_4
    FROM part)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
