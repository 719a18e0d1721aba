"""Conversation and thread state held in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.payloads import THREAD_SCHEMA, extract_message_text
from ..functions.text import epoch_ms_to_ts, null_zero_parent
from .curate import keep_latest_snapshot
from .sequences import last_before, number_rows, running_sum

HISTORY_PART = 64


def latest_per_key(
    updates: DataFrame, key: str | list[str], order: list[str], first: dict[str, str] | None = None
) -> DataFrame:
    """The last update of every key, in one aggregate.

    ``first`` adds columns with the smallest value of another one over all updates of the key.
    ``max_by`` and ``min`` combine on the map side, so hot keys stay cheap.
    """
    keys = [key] if isinstance(key, str) else key
    first = first or {}
    columns = [c for c in updates.columns if c not in keys and c not in first]
    return (
        updates.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*columns), F.struct(*order)).alias("_u"),
            *[F.min(source).alias(out) for out, source in first.items()],
        )
        .select(*keys, *[F.col(f"_u.{c}").alias(c) for c in columns], *first)
    )


def merge_by_key(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    on_match: dict[str, Column | None],
    on_insert: dict[str, Column | None],
) -> DataFrame:
    """``MERGE`` as a full outer join of two tables that are unique on the key.

    Values are built from columns of the update under the prefix ``s.``. A matched row takes
    ``on_match`` even where that is null; columns it does not name keep their old value.
    """
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = updates.withColumn("_in_s", F.lit(True)).alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    in_t, in_s = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()
    out = [F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key)]
    for c in target.columns:
        if c == key:
            continue
        old = F.col(f"t.{c}")
        inserted = on_insert.get(c, F.lit(None))
        out.append(
            F.when(in_t & in_s, on_match.get(c, old))
            .when(in_s, inserted)
            .otherwise(old)
            .alias(c)
        )
    return joined.select(*out)


def upsert_conversations(conversations: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Point conversations to their thread and last answer.

    ``created_at`` stays from the first insert, everything else is replaced, nulls included. Of
    several updates of a key the last by ``order`` counts.
    """
    # The first update of a new key sets created_at.
    latest = latest_per_key(updates, "conversation_id", order, {"created_at": "updated_at"})
    replaced = {
        c: F.col(f"s.{c}")
        for c in ["thread_id", "last_assistant_message_id", "origin_application", "updated_at"]
    }
    return merge_by_key(
        conversations,
        latest,
        "conversation_id",
        on_match=replaced,
        on_insert={**replaced, "created_at": F.col("s.created_at")},
    )


def upsert_chat_session(sessions: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Replace the chat history; ``last_updated`` is stamped on a match and left null on insert."""
    latest = latest_per_key(updates, "session_id", order)
    return merge_by_key(
        sessions,
        latest,
        "session_id",
        on_match={"chat_history": F.col("s.chat_history"), "last_updated": F.col("s.updated_at")},
        on_insert={"chat_history": F.col("s.chat_history")},
    )


def point_lookup(conversations: DataFrame, conversation_id) -> DataFrame:
    """Thread and parent message of one conversation; no answer yet means parent 0."""
    return conversations.filter(F.col("conversation_id") == F.lit(conversation_id)).select(
        "conversation_id",
        "thread_id",
        F.coalesce("last_assistant_message_id", F.lit(0).cast("bigint")).alias("parent_message_id"),
    )


def get_or_create_thread(conversations: DataFrame, incoming: DataFrame) -> DataFrame:
    """Thread and parent message for each incoming conversation.

    Known ones keep their thread; new ones get the next free numbers in order of their id.
    """
    asked = incoming.select("conversation_id").distinct()
    known = asked.join(conversations, "conversation_id").select(
        "conversation_id",
        "thread_id",
        F.coalesce("last_assistant_message_id", F.lit(0).cast("bigint")).alias("parent_message_id"),
        F.lit(False).alias("created"),
    )
    new = number_rows(
        asked.join(conversations, "conversation_id", "left_anti"), ["conversation_id"], "_n"
    )
    top = conversations.agg(F.coalesce(F.max("thread_id"), F.lit(0)).alias("_top"))
    allotted = new.withColumn("_top", top.scalar()).select(
        "conversation_id",
        (F.col("_top") + F.col("_n")).alias("thread_id"),
        F.lit(0).cast("bigint").alias("parent_message_id"),
        F.lit(True).alias("created"),
    )
    return known.unionByName(allotted)


def parent_message_ids(messages: DataFrame) -> DataFrame:
    """Parent of each user turn: the last assistant message before it, else 0."""
    answer_id = F.when(F.col("role") == "assistant", F.col("message_id"))
    with_parent = last_before(messages, ["conv_id"], "turn", answer_id, "parent_message_id")
    return with_parent.filter("role = 'user'").withColumn(
        "parent_message_id", F.coalesce("parent_message_id", F.lit(0).cast("bigint"))
    )


def list_conversations(conversations: DataFrame, limit: int = 50) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "conversation_id").limit(limit)


def conversation_messages(messages: DataFrame) -> DataFrame:
    """The user and assistant messages of threads as plain text; empty ones are left out."""
    return (
        messages.filter(F.col("role").isin("user", "assistant"))
        .withColumn("content", extract_message_text(F.col("message_payload")))
        .filter("content <> ''")
    )


def exchange_count(messages: DataFrame) -> DataFrame:
    """Exchanges per conversation: half of its user and assistant messages, rounded down."""
    return (
        messages.filter(F.col("role").isin("user", "assistant"))
        .groupBy("conv_id")
        .agg(F.floor(F.count("*") / 2).alias("exchanges"))
    )


def flatten_threads(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thread rows and message rows from JSON descriptions with their ``ingested_at``.

    Descriptions without a thread id and messages without a message id are left out.
    """
    parsed = described.select(
        F.from_json("description", THREAD_SCHEMA).alias("d"), "ingested_at"
    ).filter("d.metadata.thread_id is not null")
    threads = parsed.select(
        "d.metadata.thread_id",
        "d.metadata.thread_name",
        "d.metadata.origin_application",
        epoch_ms_to_ts(F.col("d.metadata.created_on")).alias("created_on"),
        epoch_ms_to_ts(F.col("d.metadata.updated_on")).alias("updated_on"),
        "ingested_at",
    )
    messages = (
        parsed.select("d.metadata.thread_id", F.explode("d.messages").alias("m"), "ingested_at")
        .filter("m.message_id is not null")
        .select(
            "thread_id",
            "m.message_id",
            null_zero_parent(F.col("m.parent_id")).alias("parent_id"),
            F.coalesce("m.role", F.lit("")).alias("role"),
            F.coalesce("m.message_payload", F.lit("")).alias("message_payload"),
            "m.request_id",
            epoch_ms_to_ts(F.col("m.created_on")).alias("created_on"),
            "ingested_at",
        )
    )
    return threads, messages


def cache_thread_describe(
    threads: DataFrame, messages: DataFrame, described: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new snapshots appended and older snapshots of a key removed."""
    new_threads, new_messages = flatten_threads(described)
    return (
        keep_latest_snapshot(threads.unionByName(new_threads), ["thread_id"]),
        keep_latest_snapshot(messages.unionByName(new_messages), ["thread_id", "message_id"]),
    )


def message_struct(role: str, text: str) -> Column:
    """``{"role", "content": [{"type": "text", "text"}]}`` as a struct."""
    item = F.struct(F.lit("text").alias("type"), F.col(text).alias("text"))
    return F.struct(F.col(role).alias("role"), F.array(item).alias("content"))


def _in_parts(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Messages of the keys in parts of at most ``HISTORY_PART``, each a JSON array in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", message_struct("role", "text").alias("m"))))
    return (
        numbered.withColumn("part_no", F.expr(f"_before div {HISTORY_PART}"))
        .groupBy(*keys, "part_no")
        .agg(turns.alias("_turns"))
        .select(
            *keys,
            "part_no",
            F.size("_turns").cast("bigint").alias("n_messages"),
            F.to_json(F.transform("_turns", lambda t: t["m"])).alias("messages"),
        )
    )


def _numbered(messages: DataFrame) -> DataFrame:
    """``_before``: how many messages of the conversation come earlier."""
    one = F.lit(1).cast("bigint")
    return running_sum(messages, ["conv_id"], "turn", one, "_before")


def stateless_history(messages: DataFrame) -> DataFrame:
    """The messages to send with each user turn: (conv_id, turn, part_no, n_messages, messages).

    The last user turn of a conversation gets its whole history as JSON arrays of at most
    ``HISTORY_PART`` messages, numbered from 0; put end to end they are the array to send. An
    earlier user turn gets one row without part and messages: its history is the first
    ``n_messages`` of the same array. So the rows grow with the turns, and nothing is left out.
    """
    numbered = _numbered(messages)
    users = numbered.filter("role = 'user'")
    last = users.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    open_ = numbered.join(last, "conv_id").filter(F.col("turn") <= F.col("_last"))
    whole = _in_parts(open_, ["conv_id", "_last"]).withColumnRenamed("_last", "turn")
    earlier = users.join(last, "conv_id").filter(F.col("turn") < F.col("_last")).select(
        "conv_id",
        "turn",
        F.lit(None).cast("bigint").alias("part_no"),
        (F.col("_before") + 1).alias("n_messages"),
        F.lit(None).cast("string").alias("messages"),
    )
    return whole.select(*earlier.columns).unionByName(earlier)


def history_chunks(messages: DataFrame) -> DataFrame:
    """The whole history of each conversation in parts of at most ``HISTORY_PART`` messages."""
    return _in_parts(_numbered(messages), ["conv_id"])
