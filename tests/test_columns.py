"""Edge cases of the column functions."""

import json

from pyspark.sql import functions as F

from ticketmill.functions import fixed_values as V
from ticketmill.functions import payloads as J
from ticketmill.functions import text as X
from ticketmill.functions.language import detect_language
from ticketmill.operators import rules as R


def apply(spark, values, fn, kind="string"):
    """The function over one column of values, results in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_strip_cuts_what_python_cuts(spark):
    values = ["  a ", "  b　", "\x1c c \x85", "", "​d"]
    assert apply(spark, values, X.strip) == [v.strip() for v in values]


def test_strip_prefixes(spark):
    values = [
        "Cleaned Answer: Cleaned: done",
        "Cleaned: Cleaned Answer: kept",
        " Here's the cleaned version:\n x ",
        "nothing",
        None,
    ]
    assert apply(spark, values, X.strip_prefixes) == [
        "done", "Cleaned Answer: kept", "x", "nothing", None,
    ]


def test_render_prompt_fills_values_again(spark):
    df = spark.createDataFrame([("q {answer}", "A"), (None, "A")], "q string, a string")
    prompt = X.render_prompt("{{x}} {query}|{answer}", {"query": F.col("q"), "answer": F.col("a")})
    assert [r[0] for r in df.select(prompt).collect()] == ["{{x}} q A|A", None]


def test_render_prompt_format_fills_once(spark):
    df = spark.createDataFrame([("q {a}", None)], "q string, a string")
    prompt = X.render_prompt_format(
        "{{x}} {q}|{a}", {"q": F.col("q"), "a": F.col("a")}, {"a": "none"}
    )
    assert df.select(prompt).first()[0] == "{x} q {a}|none"


def test_normalize_priority(spark):
    values = ["urgent", "High priority", "medium.", "???", None, "not high but URGENT", "low"]
    assert apply(spark, values, X.normalize_priority) == [
        "URGENT", "HIGH", "MEDIUM", "LOW", "LOW", "URGENT", "LOW",
    ]


def test_extract_json_object(spark):
    values = ['a {"x": {"y": 1}} b', "no braces", "} {", 'l1\n{"a":\n1}\nl2']
    assert apply(spark, values, X.extract_json_object) == [
        '{"x": {"y": 1}}', "no braces", "} {", '{"a":\n1}',
    ]


def test_parse_topic_intent(spark):
    values = ['x {"topic": "bug"} y', "{'topic': 'bug'}", '{"topic": null, "intent": "request"}', None]
    found = apply(spark, values, J.parse_topic_intent)
    assert [(f["topic"], f["intent"]) for f in found] == [
        ("bug", "question"), ("other", "question"), ("other", "request"), ("other", "question"),
    ]


def test_parse_judge_response(spark):
    values = [
        '{"score": 0.5, "explanation": "e"}',
        'text\n```json\n{"score": 1}\n```\nmore',
        '```\n{"score": "0.7"}\n```',
        'prose {"score": 0.25, "explanation": "in"} prose',
        "[1]",
        "broken " + "x" * 200,
        None,
        '{"score": 1.5}',
        '{"score": "high"}',
    ]
    found = apply(spark, values, J.parse_judge_response)
    assert [(f["score"], f["explanation"], f["parse_ok"]) for f in found] == [
        (0.5, "e", True),
        (1.0, "", True),
        (0.7, "", True),
        (0.25, "in", True),
        (0.0, V.PARSE_FAILED, False),
        (0.0, V.PARSE_FAILED, False),
        (0.0, V.INVALID_RESPONSE, False),
        (1.5, "", True),
        (0.0, "", True),
    ]
    assert found[5]["error"] == ("broken " + "x" * 200)[:100]


def test_extract_message_text(spark):
    def payload(*items):
        return json.dumps({"role": "assistant", "content": list(items)})

    values = [
        payload({"type": "text", "text": "  Restart it"}, {"type": "chart"}, {"type": "text", "text": "then wait.  "}),
        payload({"type": "text", "text": None}, {"type": "text"}),
        payload(),
        "\tno JSON at all\n",
        "{half a",
        None,
    ]
    assert apply(spark, values, J.extract_message_text) == [
        "Restart it\nthen wait.", "", "", "no JSON at all", "{half a", None,
    ]


def test_join_context(spark):
    assert apply(spark, [["a", "b"], [], None], J.join_context, "array<string>") == [
        "a\n\n---\n\nb", V.NO_CONTEXT_MARK, V.NO_CONTEXT_MARK,
    ]


def test_detect_language(spark):
    texts = [
        (1, "The weather is nice today and we would like to know what happened with the order"),
        (2, "Könnten Sie bitte überprüfen, warum die Bestellung nicht eingetroffen ist"),
        (3, "12345"),
        (4, ""),
    ]
    df = detect_language(spark.createDataFrame(texts, "i int, text string"))
    assert [r["language"] for r in df.orderBy("i").collect()] == ["en", "de", "de", "de"]


def test_epoch_and_parent(spark):
    times = apply(spark, [0, 1700000000123, None], X.epoch_ms_to_ts, "bigint")
    assert [str(t) for t in times] == ["1970-01-01 00:00:00", "2023-11-14 22:13:20.123000", "None"]
    assert apply(spark, [0, 5, None], X.null_zero_parent, "bigint") == [None, 5, None]


def test_rules_on_real_sentences(spark):
    issues = [
        "I cannot log in, my password is rejected",
        "Die Rechnung ist falsch",
        "URGENT: outage in production",
        "Would be great to have dark mode",
    ]
    assert apply(spark, issues, R.rule_topic) == ["login", "billing", "other", "feature_request"]
    assert apply(spark, issues, R.rule_priority) == ["LOW", "LOW", "URGENT", "LOW"]
    answer = "Dear Ms Miller,\nRestart the server.\nI hope this helps!\nBest regards,"
    assert apply(spark, [answer], R.rewrite_answer) == ["Restart the server."]
    body = "Hallo zusammen,\nder   Server ist DRINGEND neu zu starten. Vielen Dank im Voraus!"
    assert apply(spark, [body], R.rewrite_body) == ["der Server ist DRINGEND neu zu starten."]
