"""Text columns: trimming, templates, labels, tokens, ids and times."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used at several places, or inside a lambda, may be put there as a whole expression and
    computed each time. Inside a one-element ``transform`` it is a bound variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Cut white space at both ends, Unicode blanks included (plain ``trim`` cuts U+0020 only)."""
    return F.btrim(text, F.lit(V.STRIP_CHARS))


def _cut_prefix(prefix: str) -> Callable[[Column], Column]:
    def cut(text: Column) -> Column:
        rest = strip(F.substring(text, len(prefix) + 1, 2147483647))
        return F.when(text.startswith(prefix), rest).otherwise(text)

    return cut


def strip_prefixes(text: Column, prefixes: list[str] | None = None) -> Column:
    """Strip, then cut each known prefix in turn and strip again; several can go."""
    out = strip(text)
    for prefix in prefixes or V.ANSWER_PREFIXES:
        out = let(out, _cut_prefix(prefix))
    return out


def clip_text(text: Column, length: int = 100) -> Column:
    return F.substring(text, 1, length)


def render_prompt(template: str, holes: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` holes one after the other.

    A value that itself holds a later hole is filled again, doubled braces stay doubled and a null
    value makes the whole prompt null, as nested SQL ``REPLACE`` calls do.
    """
    out = F.lit(template)
    for name, value in holes.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def render_prompt_format(
    template: str, holes: Mapping[str, Column], defaults: Mapping[str, str] | None = None
) -> Column:
    """Fill all holes in one pass: values are never looked at again, ``{{`` means ``{``."""
    defaults = defaults or {}
    pieces = []
    for part in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if part in ("{{", "}}"):
            pieces.append(F.lit(part[0]))
        elif re.fullmatch(r"\{\w+\}", part):
            name = part[1:-1]
            value = holes[name]
            pieces.append(F.coalesce(value, F.lit(defaults[name])) if name in defaults else value)
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def normalize_label(text: Column) -> Column:
    return F.upper(strip(text))


def normalize_priority(text: Column) -> Column:
    """First match of URG, HIGH, MED wins; everything else, null included, is LOW."""
    raw = normalize_label(text)
    return (
        F.when(raw.contains("URG"), "URGENT")
        .when(raw.contains("HIGH"), "HIGH")
        .when(raw.contains("MED"), "MEDIUM")
        .otherwise("LOW")
    )


def extract_json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; the text itself when there is no such span."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found == "", text).otherwise(found)


def short_id(uuid: Column) -> Column:
    return F.substring(uuid, 1, 8)


def format_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def epoch_ms_to_ts(ms: Column) -> Column:
    """Milliseconds since 1970 to a UTC time without zone; null stays null."""
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def null_zero_parent(parent_id: Column) -> Column:
    return F.nullif(parent_id, F.lit(0).cast("bigint"))


def concat_embed_text(*parts: Column) -> Column:
    """Parts joined by blanks; a null part is left out instead of making the text null."""
    return F.concat_ws(" ", *parts)


def words(text: Column) -> Column:
    """Lower-case words: runs of anything but white space and ASCII punctuation."""
    split = F.split(F.lower(text), WORD_GAP)
    return F.filter(split, lambda w: w != "")


# The same pattern is used by the checking SQL, so it sticks to syntax both engines read alike.
WORD_GAP = r"[ \t\r\n!-/:-@\[-`{-~]+"


def sentences(text: Column) -> Column:
    """Pieces between line ends and sentence marks, trimmed, empty ones dropped."""
    split = F.split(text, SENTENCE_GAP)
    return F.filter(F.transform(split, lambda s: F.trim(s)), lambda s: s != "")


SENTENCE_GAP = r"[.!?\n]+"
