"""JSON payload columns: judge answers, chat messages, tool steps, usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import clip_text, extract_json_object, let, strip

STRICT = {"allowSingleQuotes": "false"}
CONTENT_SCHEMA = "content array<struct<type string, text string>>"
STEP_SCHEMA = """content array<struct<
    type string,
    tool_use struct<name string, input string>,
    tool_result struct<name string, status string, content string>>>"""
THREAD_SCHEMA = """metadata struct<thread_id bigint, thread_name string, origin_application string,
        created_on bigint, updated_on bigint>,
    messages array<struct<message_id bigint, parent_id bigint, created_on bigint, role string,
        message_payload string, request_id string>>"""


def is_json_object(text: Column) -> Column:
    """True for text that parses and both begins and ends like an object.

    The end is tested because the JSON reader stops after the first value and would let
    ``{"a": 1} and more`` pass.
    """

    def check(trimmed: Column) -> Column:
        shaped = trimmed.startswith("{") & trimmed.endswith("}")
        return F.coalesce(shaped & F.try_parse_json(trimmed).isNotNull(), F.lit(False))

    return let(strip(text), check)


def parse_topic_intent(text: Column) -> Column:
    """``struct<topic, intent>``; whatever is missing or unreadable takes the default."""
    fields = "topic string, intent string"
    return let(
        F.from_json(extract_json_object(text), fields, STRICT),
        lambda found: F.struct(
            F.coalesce(found["topic"], F.lit(V.DEFAULT_TOPIC)).alias("topic"),
            F.coalesce(found["intent"], F.lit(V.DEFAULT_INTENT)).alias("intent"),
        ),
    )


def parse_judge_response(text: Column) -> Column:
    """``struct<score, explanation, error, parse_ok>`` from the answer of a judging model."""

    def unfence(raw: Column) -> Column:
        fenced = F.when(
            raw.contains("```json"), F.try_element_at(F.split(raw, "```json"), F.lit(2))
        ).when(raw.contains("```"), F.try_element_at(F.split(raw, "```"), F.lit(2)))
        return F.coalesce(strip(F.substring_index(fenced, "```", 1)), raw)

    def readable(inner: Column) -> Column:
        # A greedy {...} is the second try, as for answers wrapped in prose.
        braces = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
        return F.when(is_json_object(inner), inner).when(is_json_object(braces), braces)

    def judged(inner: Column, found: Column) -> Column:
        ok = found.isNotNull()
        score = F.coalesce(found["score"].try_cast("double"), F.lit(0.0))
        return F.struct(
            F.when(ok, score).otherwise(F.lit(0.0)).alias("score"),
            F.when(inner.isNull(), V.INVALID_RESPONSE)
            .when(ok, F.coalesce(found["explanation"], F.lit("")))
            .otherwise(V.PARSE_FAILED)
            .alias("explanation"),
            F.when(inner.isNotNull() & ~ok, clip_text(inner)).alias("error"),
            ok.alias("parse_ok"),
        )

    fields = "score string, explanation string"
    return let(
        let(strip(text), unfence),
        lambda inner: let(
            F.from_json(readable(inner), fields, STRICT), lambda found: judged(inner, found)
        ),
    )


def extract_message_text(payload: Column) -> Column:
    """Text items joined by line ends; a payload that is not JSON is its own text."""
    content = F.from_json(payload, CONTENT_SCHEMA, STRICT)["content"]
    texts = F.filter(
        F.transform(
            F.filter(content, lambda i: i["type"] == "text"), lambda i: i["text"]
        ),
        lambda t: t.isNotNull() & (t != ""),
    )
    joined = F.coalesce(F.array_join(texts, "\n"), F.lit(""))
    return strip(F.when(is_json_object(payload), joined).otherwise(payload))


def _steps(response: Column) -> Column:
    return F.from_json(response, STEP_SCHEMA, STRICT)["content"]


def extract_tool_steps(response: Column, search_tool: str = V.SEARCH_TOOL) -> Column:
    """``struct<used_search, tool_uses, tool_results>`` of one agent response."""
    steps = _steps(response)
    uses = F.transform(
        F.filter(steps, lambda s: s["type"] == "tool_use"), lambda s: s["tool_use"]
    )
    results = F.transform(
        F.filter(steps, lambda s: s["type"] == "tool_result"), lambda s: s["tool_result"]
    )
    return F.struct(
        F.coalesce(F.exists(uses, lambda u: u["name"] == search_tool), F.lit(False)).alias(
            "used_search"
        ),
        uses.alias("tool_uses"),
        results.alias("tool_results"),
    )


def extract_context(tool_results: Column, search_tool: str = V.SEARCH_TOOL) -> Column:
    """Contents of the successful searches, or the text that says there were none."""
    hits = F.filter(
        tool_results, lambda r: (r["name"] == search_tool) & (r["status"] == "success")
    )
    joined = F.array_join(F.transform(hits, lambda r: r["content"]), "\n\n")
    return F.when(F.size(hits) > 0, joined).otherwise(V.NO_CONTEXT)


def join_context(chunks: Column) -> Column:
    joined = F.array_join(chunks, V.CHUNK_SEPARATOR)
    return F.when(F.coalesce(joined, F.lit("")) == "", V.NO_CONTEXT_MARK).otherwise(joined)


def extract_usage(response: Column) -> Column:
    """``struct<agent_model, total_input_tokens, total_output_tokens>`` of the first usage entry."""
    entry = "$.metadata.usage.tokens_consumed[0]"

    def field(path: str) -> Column:
        return F.get_json_object(response, f"{entry}.{path}")

    return F.struct(
        field("model_name").alias("agent_model"),
        field("input_tokens.total").try_cast("bigint").alias("total_input_tokens"),
        field("output_tokens.total").try_cast("bigint").alias("total_output_tokens"),
    )
