"""Recorded agent responses: event lines to events, events to one result per response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.payloads import STRICT, extract_message_text, is_json_object
from ..functions.text import strip
from .sequences import running_sum

METADATA_SCHEMA = "metadata struct<role string, message_id bigint>"
MAX_CHARS = 2147483647


def parse_sse_events(lines: DataFrame) -> DataFrame:
    """Events of each response from its lines (response_id, line_no, line).

    A blank line ends an event, ``:`` lines are comments, the last ``event:`` line names the type
    (``message`` if none or empty), ``data:`` lines are joined by line ends, and events without data
    are dropped. The last event needs no blank line.
    """
    numbered = running_sum(
        lines.withColumn("line", F.rtrim("line", F.lit("\r"))),
        ["response_id"],
        "line_no",
        (F.col("line") == "").cast("bigint"),
        "event_no",
    )
    is_type = F.col("line").startswith("event:")
    is_data = F.col("line").startswith("data:")
    type_text = strip(F.substring("line", len("event:") + 1, MAX_CHARS))
    data_text = F.ltrim(
        F.substring("line", len("data:") + 1, MAX_CHARS), F.lit(V.STRIP_CHARS)
    )
    parts = F.collect_list(
        F.when(is_data, F.struct(F.col("line_no"), data_text.alias("text")))
    )
    return (
        numbered.groupBy("response_id", "event_no")
        .agg(
            F.max_by(F.when(is_type, type_text), F.when(is_type, F.col("line_no"))).alias("_type"),
            F.sort_array(parts).alias("_parts"),
        )
        .filter(F.size("_parts") > 0)
        .select(
            "response_id",
            "event_no",
            F.coalesce(F.nullif("_type", F.lit("")), F.lit("message")).alias("event_type"),
            F.array_join(F.transform("_parts", lambda p: p["text"]), "\n").alias("data"),
        )
    )


def fold_agent_run(events: DataFrame) -> DataFrame:
    """One row per response: message ids, answer text, payload, status.

    Of several metadata events per role and several response payloads the last readable one counts.
    A response without a readable payload gets an error status instead of failing the job.
    """
    readable = F.when(is_json_object(F.col("data")), F.col("data"))
    meta = F.from_json(readable, METADATA_SCHEMA, STRICT)["metadata"]
    typed = events.select(
        "response_id",
        "event_no",
        F.when(F.col("event_type") == "metadata", meta).alias("_meta"),
        F.when(F.col("event_type") == "response", readable).alias("_payload"),
    )

    def last_id(role: str):
        seen = F.when(F.col("_meta.role") == role, F.col("_meta.message_id"))
        return F.max_by(seen, F.when(seen.isNotNull(), F.col("event_no")))

    folded = typed.groupBy("response_id").agg(
        last_id("user").alias("user_message_id"),
        last_id("assistant").alias("assistant_message_id"),
        F.max_by("_payload", F.when(F.col("_payload").isNotNull(), F.col("event_no"))).alias(
            "raw_response"
        ),
    )
    found = F.col("raw_response").isNotNull()
    return folded.withColumn(
        "assistant_text", F.when(found, extract_message_text(F.col("raw_response")))
    ).withColumn("status", F.when(found, "ok").otherwise("missing_final_response"))
