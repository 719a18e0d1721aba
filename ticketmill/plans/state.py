"""Conversations, threads, histories and recorded responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as P
from ..operators import state as S
from ..session import scratch_path
from ..sources import sinks as K
from ..sources.keyed import create_keyed_table, keyed_table, newer, replace_keys
from . import frames as T
from .frames import with_sql
from .registry import query

ORDER = ["updated_at", "event_id"]
STATE = with_sql("updates", "state") + " SELECT * FROM state"


def halves(spark, tables):
    """Conversations as of the split date, and the updates since."""
    updates = T.conversation_updates(spark, tables)
    earlier = F.col("updated_at") < F.to_timestamp_ntz(F.lit(T.SPLIT_AT))
    return T.conversations(updates.filter(earlier)), updates.filter(~earlier)


@query("upsert_conversations", STATE)
def upsert_conversations(spark, tables):
    known, updates = halves(spark, tables)
    return S.upsert_conversations(known, updates, ORDER)


@query(
    "upsert_chat_session",
    with_sql("updates")
    + f""", session AS (
        SELECT conversation_id AS session_id, origin_application AS chat_history, updated_at,
               row_number() OVER (PARTITION BY conversation_id
                                  ORDER BY updated_at DESC, event_id DESC) AS rn,
               min(updated_at) OVER (PARTITION BY conversation_id) AS first_at,
        FROM updates)
    SELECT session_id, chat_history,
           CASE WHEN first_at < TIMESTAMP '{T.SPLIT_AT}' AND updated_at >= TIMESTAMP '{T.SPLIT_AT}'
                THEN updated_at END AS last_updated
    FROM session WHERE rn = 1""",
)
def upsert_chat_session(spark, tables):
    known, updates = halves(spark, tables)
    sessions = known.select(
        F.col("conversation_id").alias("session_id"),
        F.col("origin_application").alias("chat_history"),
        F.lit(None).cast("timestamp_ntz").alias("last_updated"),
    )
    histories = updates.select(
        F.col("conversation_id").alias("session_id"),
        F.col("origin_application").alias("chat_history"),
        "updated_at",
        "event_id",
    )
    return S.upsert_chat_session(sessions, histories, ORDER)


@query(
    "point_lookup",
    with_sql("updates", "state")
    + """ SELECT conversation_id, thread_id,
           coalesce(last_assistant_message_id, 0) AS parent_message_id
    FROM state WHERE conversation_id = '8'""",
)
def point_lookup(spark, tables):
    return S.point_lookup(T.conversations(T.conversation_updates(spark, tables)), "8")


@query(
    "get_or_create_thread",
    with_sql("updates", "state")
    + """, asked AS (SELECT DISTINCT c_custkey::VARCHAR AS conversation_id FROM customer)
    SELECT a.conversation_id,
           coalesce(thread_id, (SELECT max(thread_id) FROM state)
                    + sum((thread_id IS NULL)::INTEGER) OVER (ORDER BY a.conversation_id))::BIGINT
               AS thread_id,
           coalesce(last_assistant_message_id, 0) AS parent_message_id,
           thread_id IS NULL AS created
    FROM asked a LEFT JOIN state s ON s.conversation_id = a.conversation_id""",
)
def get_or_create_thread(spark, tables):
    known = T.conversations(T.conversation_updates(spark, tables))
    asked = T.scan(spark, tables, "customer").select(
        F.col("c_custkey").cast("string").alias("conversation_id")
    )
    return S.get_or_create_thread(known, asked)


@query(
    "parent_message_id",
    with_sql("messages")
    + """ SELECT conv_id, turn, coalesce((
        SELECT max(a.message_id) FROM messages a
        WHERE a.conv_id = m.conv_id AND a.turn < m.turn AND a.role = 'assistant'), 0)
        AS parent_message_id
    FROM messages m WHERE role = 'user'""",
)
def parent_message_id(spark, tables):
    rows = T.messages(spark, tables).select("conv_id", "turn", "role", "message_id")
    return S.parent_message_ids(rows).select("conv_id", "turn", "parent_message_id")


@query(
    "list_conversations",
    with_sql("updates", "state")
    + " SELECT * FROM state ORDER BY updated_at DESC, conversation_id LIMIT 50",
)
def list_conversations(spark, tables):
    return S.list_conversations(T.conversations(T.conversation_updates(spark, tables)))


def payload_sql(row: str) -> str:
    item = f"{{'type': 'text', 'text': {row}.text}}"
    return f"to_json({{'role': {row}.role, 'content': [{item}]}})::VARCHAR"


PAGE = 100


def described_threads(spark, tables, ingested_at: str):
    """Conversations as thread descriptions in JSON, one page of messages per row."""
    message = F.struct(
        "message_id",
        F.col("turn").alias("parent_id"),
        (F.col("turn") * 1000).alias("created_on"),
        "role",
        F.to_json(S.message_struct("role", "text")).alias("message_payload"),
        F.lit(None).cast("string").alias("request_id"),
    )
    pages = T.messages(spark, tables).groupBy(
        "conv_id", F.floor(F.col("turn") / PAGE).alias("page")
    ).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    metadata = F.struct(
        F.col("conv_id").alias("thread_id"),
        F.lit("support").alias("origin_application"),
        (F.col("conv_id") * 1000).alias("created_on"),
    )
    return pages.select(
        F.to_json(F.struct(metadata.alias("metadata"), "messages")).alias("description"),
        F.to_timestamp_ntz(F.lit(ingested_at)).alias("ingested_at"),
    )


@query(
    "cache_thread_describe",
    with_sql("messages")
    + f""" SELECT conv_id AS thread_id, message_id, nullif(turn, 0) AS parent_id, role,
           {payload_sql('messages')} AS message_payload, NULL::VARCHAR AS request_id,
           make_timestamp(turn * 1000000) AS created_on,
           TIMESTAMP '2024-02-02 00:00:00' AS ingested_at,
           make_timestamp(conv_id * 1000000) AS thread_created_on
    FROM messages""",
)
def cache_thread_describe(spark, tables):
    """Both tables after two deliveries; the second one replaces the snapshots of the first."""
    path = scratch_path(spark, "app")
    database = f"app_{path.rsplit('-', 1)[1]}"
    K.ensure_database(spark, database, path)
    keys = {"threads": ["thread_id"], "thread_messages": ["thread_id", "message_id"]}
    first, second = (
        S.flatten_threads(described_threads(spark, tables, f"2024-02-0{n} 00:00:00")) for n in (1, 2)
    )
    for (name, key), rows, later in zip(keys.items(), first, second):
        # Pages of a thread repeat its row.
        create_keyed_table(rows.dropDuplicates(key), f"{database}.{name}", key)
        replace_keys(f"{database}.{name}", later.dropDuplicates(key), newer(key, ["ingested_at"]))
    threads, messages = (keyed_table(spark, f"{database}.{name}") for name in keys)
    created = threads.select("thread_id", F.col("created_on").alias("thread_created_on"))
    return messages.join(created, "thread_id")


PARTS = f"""numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before,
               max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_turn
        FROM conversations)"""


@query(
    "stateless_history",
    f"""WITH {PARTS}
    SELECT conv_id, last_turn AS turn, before // {S.HISTORY_PART} AS part_no, count(*) AS n_messages,
           '[' || string_agg({payload_sql('m')}, ',' ORDER BY turn) || ']' AS messages
    FROM numbered m WHERE turn <= last_turn GROUP BY conv_id, last_turn, part_no
    UNION ALL
    SELECT conv_id, turn, NULL, before + 1, NULL FROM numbered
    WHERE role = 'user' AND turn < last_turn""",
)
def stateless_history(spark, tables):
    return S.stateless_history(T.messages(spark, tables))


@query(
    "history_chunks",
    f"""WITH {PARTS}
    SELECT conv_id, before // {S.HISTORY_PART} AS part_no, count(*) AS n_messages,
           '[' || string_agg({payload_sql('m')}, ',' ORDER BY turn) || ']' AS messages
    FROM numbered m GROUP BY ALL""",
)
def history_chunks(spark, tables):
    return S.history_chunks(T.messages(spark, tables))


# --- recorded responses ---------------------------------------------------------------------------


def response_lines(spark, tables):
    """Conversations as event lines, one response per conversation, eight lines per turn.

    Each turn gives a comment, a metadata event and, for assistant turns, a response event with its
    JSON cut over two data lines; user turns give an event without data instead.
    """
    m = T.messages(spark, tables)
    is_answer = F.col("role") == "assistant"
    meta = F.to_json(F.struct(F.struct("role", "message_id").alias("metadata")))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))
    lines = F.array(
        F.lit(": keep-alive"),
        F.lit("event: metadata"),
        F.concat(F.lit("data: "), meta),
        F.lit(""),
        F.when(is_answer, F.lit("event:response")).otherwise(F.lit("event: ping")),
        F.when(is_answer, F.concat(F.lit("data: "), F.substring(payload, 1, 1))).otherwise(F.lit(": x")),
        F.when(is_answer, F.concat(F.lit("data:"), F.substr(payload, F.lit(2)))).otherwise(F.lit(": y")),
        F.lit("\r"),
    )
    return m.select(
        F.col("conv_id").alias("response_id"),
        F.posexplode(lines).alias("p", "line"),
        "turn",
    ).select("response_id", (F.col("turn") * 8 + F.col("p")).alias("line_no"), "line")


CONTENT_SQL = "to_json({'content': [{'type': 'text', 'text': text}]})::VARCHAR"


@query(
    "parse_sse_events",
    with_sql("messages")
    + f""" SELECT conv_id AS response_id, turn * 2 AS event_no, 'metadata' AS event_type,
           to_json({{'metadata': {{'role': role, 'message_id': message_id}}}})::VARCHAR AS data
    FROM messages
    UNION ALL
    SELECT conv_id, turn * 2 + 1, 'response',
           '{{' || chr(10) || substr({CONTENT_SQL}, 2) FROM messages WHERE role = 'assistant'""",
)
def parse_sse_events(spark, tables):
    return P.parse_sse_events(response_lines(spark, tables))


@query(
    "fold_agent_run",
    with_sql("messages")
    + """, ids AS (
        SELECT conv_id AS response_id, max(message_id) FILTER (role = 'user') AS user_message_id,
               max(message_id) FILTER (role = 'assistant') AS assistant_message_id
        FROM messages GROUP BY conv_id)
    SELECT i.*, m.text AS assistant_text,
           CASE WHEN m.text IS NULL THEN 'missing_final_response' ELSE 'ok' END AS status
    FROM ids i LEFT JOIN messages m
      ON m.conv_id = i.response_id AND m.message_id = i.assistant_message_id""",
)
def fold_agent_run(spark, tables):
    events = P.parse_sse_events(response_lines(spark, tables))
    return P.fold_agent_run(events).drop("raw_response")


@query(
    "extract_message_text",
    """SELECT conv_id, turn, role, trim(text) AS content FROM conversations
    WHERE role IN ('user', 'assistant') AND trim(text) <> ''""",
)
def extract_message_text(spark, tables):
    """Payloads as JSON for assistant turns, as plain text for the others."""
    payload = F.when(
        F.col("role") == "assistant", F.to_json(S.message_struct("role", "text"))
    ).otherwise(F.concat("text", F.lit("\n")))
    rows = T.messages(spark, tables).withColumn("message_payload", payload)
    return S.conversation_messages(rows).select("conv_id", "turn", "role", "content")
