"""Keyword rules: the default stand-in for a hosted model, so that results can be checked.

The rules cover English and German. They are a stand-in and make no claim to a model's quality; the
batch model runner in ``inference`` takes any callable in their place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip, strip_prefixes

# First matching row wins; a keyword counts anywhere in the lower-case text.
TOPIC_KEYWORDS = [
    ("login", ["login", "log in", "password", "anmeld", "passwort", "sign in"]),
    ("billing", ["invoice", "billing", "payment", "refund", "rechnung", "zahlung"]),
    ("bug", ["error", "crash", "broken", "bug", "fehler", "absturz"]),
    ("feature_request", ["feature", "would be great", "funktionswunsch", "could you add"]),
    ("how_to", ["how to", "how do i", "how can i", "wie kann ich", "anleitung"]),
    ("account", ["account", "profile", "konto", "profil"]),
]
INTENT_KEYWORDS = [
    ("incident", ["outage", "down", "crash", "error", "ausfall", "fehler"]),
    ("complaint", ["disappointed", "unacceptable", "complain", "beschwer", "enttäuscht"]),
    ("request", ["please", "request", "would like", "bitte", "möchte"]),
]
PRIORITY_KEYWORDS = [
    ("URGENT", ["urgent", "outage", "security", "data loss", "payment fail", "dringend", "ausfall"]),
    ("HIGH", ["multiple users", "all users", "integration", "mehrere nutzer", "not working"]),
    ("MEDIUM", ["error", "problem", "issue", "bug", "fehler", "help", "hilfe"]),
]
ANSWER_TYPE_KEYWORDS = [
    ("ESCALATION", ["escalat", "forwarded", "specialist", "weitergeleitet", "eskalier"]),
    ("CLARIFICATION", ["could you", "please provide", "more information", "könnten sie", "bitte teilen"]),
    ("RESOLUTION", ["resolved", "fixed", "follow these steps", "behoben", "gelöst"]),
]
GREETINGS = ["hello", "hi", "dear", "good morning", "hallo", "guten tag", "sehr geehrte"]
SIGN_OFFS = [
    "best regards", "kind regards", "regards", "sincerely", "thank you", "thanks",
    "mit freundlichen grüßen", "viele grüße", "danke", "vielen dank",
]
FILLERS = [
    "i hope this helps", "please let me know", "feel free to contact us",
    "ich hoffe, das hilft", "bitte lassen sie es mich wissen",
]
PLEASANTRIES = ["i hope you are well", "thanks in advance", "ich hoffe, es geht ihnen gut", "vielen dank im voraus"]
ESCALATION_TEXT = "This ticket has been escalated to our support team."
NO_CONTEXT_TEXT = "No matching article was found; please treat this reply as unverified."


def keyword_label(text: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    low = F.lower(text)
    label = None
    for name, keywords in table:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | low.contains(keyword)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(default)


def rule_topic(text: Column) -> Column:
    return keyword_label(text, TOPIC_KEYWORDS, V.DEFAULT_TOPIC)


def rule_intent(text: Column) -> Column:
    return keyword_label(text, INTENT_KEYWORDS, V.DEFAULT_INTENT)


def rule_priority(text: Column) -> Column:
    return keyword_label(text, PRIORITY_KEYWORDS, "LOW")


def rule_answer_type(answer: Column) -> Column:
    return keyword_label(answer, ANSWER_TYPE_KEYWORDS, "PARTIAL")


def line_pattern(openings: list[str]) -> str:
    """A line that is nothing but one of the openings, a few more words, and marks."""
    return "^(" + "|".join(openings) + ")([ ,]+[^ .!?]+){0,3}[ ,.!]*$"


def phrase_pattern(phrases: list[str]) -> str:
    return "(" + "|".join(phrases) + ")[.!]?"


def drop_lines(text: Column, pattern: str) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.lower(F.trim(line)).rlike(pattern))
    return F.array_join(kept, "\n")


def rewrite_answer(answer: Column) -> Column:
    """Without greeting lines, sign-off lines and filler phrases, then without known prefixes."""
    body = drop_lines(answer, line_pattern(GREETINGS + SIGN_OFFS))
    body = F.regexp_replace(body, "(?i)" + phrase_pattern(FILLERS), "")
    return strip_prefixes(body)


def rewrite_body(body: Column) -> Column:
    """Without greeting lines and pleasantries, runs of blanks made one; urgency words stay."""
    text = drop_lines(body, line_pattern(GREETINGS))
    text = F.regexp_replace(text, "(?i)" + phrase_pattern(PLEASANTRIES), "")
    return strip(F.regexp_replace(text, "[ \t]+", " "))


def policy_guardrails(response: Column, priority: Column, has_context: Column) -> Column:
    """Escalation wording for URGENT and HIGH, a mark for replies without context."""
    return F.concat(
        response,
        F.when(priority.isin("URGENT", "HIGH"), "\n" + ESCALATION_TEXT).otherwise(""),
        F.when(~has_context, "\n" + NO_CONTEXT_TEXT).otherwise(""),
    )
