"""Edge cases of curation, sampling, sequences, state and responses."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ticketmill.operators import curate as C
from ticketmill.operators import profile as P
from ticketmill.operators import relate as L
from ticketmill.operators import responses as E
from ticketmill.operators import sampling as S
from ticketmill.operators import sequences as Q
from ticketmill.operators import state as T
from ticketmill.sources import readers


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- curation


def test_min_length_counts_characters(spark):
    texts = ["x" * 49, "x" * 50, "ä" * 50, "😀" * 49, None]
    df = spark.createDataFrame([(i, t, "y" * 60) for i, t in enumerate(texts)], "i int, body string, answer string")
    assert [r["i"] for r in C.filter_min_length(df, ["body", "answer"]).orderBy("i").collect()] == [1, 2]


def test_column_rule(spark):
    df = spark.createDataFrame([(1,) * 6], "body int, version int, tag_1 int, tag_2 int, tag_3 int, vintage int")
    assert C.select_columns_by_rule(df).columns == ["body", "tag_1", "tag_2"]


def test_dedup_exact_keeps_first_and_nulls_apart(spark):
    data = [(3, "a", "b"), (1, "a", "b"), (2, "ab", ""), (4, "a", None), (5, "a", None), (6, "", "ab")]
    df = spark.createDataFrame(data, "id int, body string, answer string")
    kept = C.dedup_exact(df, ["body", "answer"], ["id"])
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 2, 4, 6]


def test_newest_snapshots_tie(spark):
    data = [(1, "old", at(1)), (1, "x", at(2)), (1, "y", at(2)), (2, "z", at(1))]
    df = spark.createDataFrame(data, "k int, v string, ingested_at timestamp_ntz")
    latest = C.keep_latest_snapshot(df, ["k"])
    assert sorted(r["v"] for r in latest.collect()) == ["x", "y", "z"]
    left = C.delete_older(df, C.newest_per_key(df, ["k"]), ["k"])
    assert sorted(r["v"] for r in left.collect()) == ["x", "y", "z"]


def test_csv_dialect(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "subject,body,answer,type,queue,priority,language,version\n"
        '"a, b","say ""hi""\nagain", NULL ,null,,Null,en,51\n'
        "plain,x,y,Incident, IT ,high,de,oops\n",
        encoding="utf-8",
    )
    schema = """subject string, body string, answer string, type string, queue string,
        priority string, language string, version bigint"""
    df = readers.scan_csv_tickets(spark, str(tmp_path), schema)
    assert rows(df, "subject") == [
        ("a, b", 'say "hi"\nagain', None, None, None, "Null", "en", 51),
        ("plain", "x", "y", "Incident", "IT", "high", "de", None),
    ]


# --- sampling


def brute_sample(data, per, seed=42):
    import hashlib
    import math

    groups = {}
    for i, s in data:
        groups.setdefault(s, []).append(i)
    share = per * len(groups) / len(data)
    out = set()
    for ids in groups.values():
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
        out |= set(ids[: min(max(1, math.floor(len(ids) * share)), len(ids))])
    return out


@pytest.mark.parametrize("per", [1, 3, 40, 500])
def test_stratified_sample_is_exact(spark, per):
    rng = random.Random(per)
    data = [(i, rng.choice(["a", "a", "a", "a_b", "b", None])) for i in range(700)] + [(700, "alone")]
    df = spark.createDataFrame(data, "id int, s string")
    sample = S.sample_stratified(df, "id", ["s"], per)
    assert {r["id"] for r in sample.collect()} == brute_sample(data, per)


def test_strata_do_not_collide(spark):
    data = [(1, "a_b", "c"), (2, "a", "b_c")]
    df = spark.createDataFrame(data, "id int, x string, y string")
    assert S.sample_stratified(df, "id", ["x", "y"], 1).count() == 2


def test_sample_n_of_few_rows(spark):
    assert S.sample_n(spark.range(5), 10, "id").count() == 5


def test_slice_and_numbers_agree_beyond_the_limit(spark, monkeypatch):
    df = spark.range(0, 100, 1, 7)
    short = rows(S.slice_rows(df, 20, 30, ["id"]), "id")
    assert short == [(20 + i, i) for i in range(10)]
    key = S.shuffle_key("id")
    want = {r["id"] for r in df.orderBy(key, "id").limit(30).collect()}
    assert {r["id"] for r in S.sample_n(df, 30, "id").collect()} == want
    monkeypatch.setattr(S, "CELL_DIGITS", 1)
    assert {r["id"] for r in S.sample_n(df, 30, "id").collect()} == want


# --- sequences: one key holds most rows, blocks are small


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(1)
    data = [(0, t, rng.choice([None, None, t])) for t in range(200)]
    data += [(k, t, rng.choice([None, t])) for k in range(1, 6) for t in range(0, 15, 2)]
    return data, spark.createDataFrame(data, "k int, t bigint, v bigint")


def test_last_before_next_after_running_sum(turns):
    data, df = turns
    before = {(r["k"], r["t"]): r["o"] for r in Q.last_before(df, ["k"], "t", F.col("v"), "o", 7).collect()}
    after = {(r["k"], r["t"]): r["o"] for r in Q.next_after(df, ["k"], "t", F.col("v"), "o", 7).collect()}
    total = {(r["k"], r["t"]): r["o"] for r in Q.running_sum(df, ["k"], "t", F.col("v"), "o", 7).collect()}
    for k, t, _ in data:
        earlier = [v for kk, tt, v in data if kk == k and tt < t and v is not None]
        later = [v for kk, tt, v in data if kk == k and tt > t and v is not None]
        assert before[k, t] == (max(earlier) if earlier else None)
        assert after[k, t] == (min(later) if later else None)
        assert total[k, t] == sum(earlier)


def test_number_rows_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    numbered = Q.number_rows(df, ["x"], "n").collect()
    assert sorted((r["x"], r["n"]) for r in numbered) == [(i, i + 1) for i in range(1000)]


# --- state


CONVERSATION = """conversation_id string, thread_id bigint, last_assistant_message_id bigint,
    origin_application string, created_at timestamp_ntz, updated_at timestamp_ntz"""
UPDATE = """conversation_id string, thread_id bigint, last_assistant_message_id bigint,
    origin_application string, updated_at timestamp_ntz, event_id bigint"""


def test_upsert_conversations(spark):
    known = spark.createDataFrame(
        [("a", 1, 10, "app", at(1), at(1)), ("b", 2, 20, "app", at(1), at(1))], CONVERSATION
    )
    updates = spark.createDataFrame(
        [
            ("a", 1, None, "app2", at(3), 3),
            ("a", 1, 11, "app", at(2), 2),
            ("c", 3, 30, "app", at(2), 4),
            ("c", 3, 31, "app", at(2), 5),
        ],
        UPDATE,
    )
    merged = T.upsert_conversations(known, updates, ["updated_at", "event_id"])
    assert rows(merged, "conversation_id") == [
        ("a", 1, None, "app2", at(1), at(3)),
        ("b", 2, 20, "app", at(1), at(1)),
        ("c", 3, 31, "app", at(2), at(2)),
    ]


def test_threads_are_reused_or_allotted(spark):
    known = spark.createDataFrame(
        [("old", 310, 65, "app", at(1), at(1)), ("quiet", 7, None, "app", at(1), at(1))], CONVERSATION
    )
    asked = spark.createDataFrame([("old",), ("new2",), ("new1",), ("quiet",), ("new1",)], "conversation_id string")
    assert rows(T.get_or_create_thread(known, asked), "conversation_id") == [
        ("new1", 311, 0, True),
        ("new2", 312, 0, True),
        ("old", 310, 65, False),
        ("quiet", 7, 0, False),
    ]
    assert rows(T.point_lookup(known, "quiet"), "conversation_id") == [("quiet", 7, 0)]


def test_thread_descriptions_without_ids_are_left_out(spark):
    good = (
        '{"metadata": {"thread_id": 1, "created_on": 1000},'
        ' "messages": [{"message_id": 5, "parent_id": 0}, {"role": "user"}]}'
    )
    df = spark.createDataFrame(
        [(good, at(1)), ('{"metadata": {}}', at(1)), ("broken", at(1))],
        "description string, ingested_at timestamp_ntz",
    )
    threads, messages = T.flatten_threads(df)
    assert rows(threads, "thread_id") == [(1, None, None, dt.datetime(1970, 1, 1, 0, 0, 1), None, at(1))]
    assert rows(messages, "message_id") == [(1, 5, None, "", "", None, None, at(1))]


@pytest.mark.parametrize("turns", [1, 64, 65, 130, 10_000])
def test_parts_put_together_are_the_whole_history(spark, turns):
    role = lambda t: "user" if t % 2 == 0 else "assistant"
    data = [(1, 3 * t, role(t), f"m{t}") for t in range(turns)] + [(2, 0, "assistant", "alone")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    sent = T.stateless_history(df).collect()
    last = max(r["turn"] for r in sent)
    parts = sorted((r["part_no"], r["n_messages"], r["messages"]) for r in sent if r["turn"] == last)
    whole = [m["content"][0]["text"] for _, _, part in parts for m in json.loads(part)]
    assert whole == [f"m{t}" for t in range(last // 3 + 1)]
    assert all(n == len(json.loads(part)) <= 64 for _, n, part in parts)
    earlier = {r["turn"]: (r["part_no"], r["n_messages"]) for r in sent if r["turn"] < last}
    assert earlier == {3 * t: (None, t + 1) for t in range(0, last // 3, 2)}
    chunks = sorted((r["part_no"], r["messages"]) for r in T.history_chunks(df).collect() if r["conv_id"] == 1)
    assert sum(len(json.loads(c)) for _, c in chunks) == turns


def test_qa_pairs_skip_to_the_next_answer(spark):
    data = [
        (1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "user", "q2"),
        (1, 3, "assistant", "a"), (1, 4, "user", "q3"),
    ]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    pairs = L.qa_pairs(df).select("turn", "body", "answer")
    assert rows(pairs, "turn") == [(1, "q1", "a"), (2, "q2", "a")]


# --- recorded responses


def response(spark, *lines):
    data = [("r", i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(data, "response_id string, line_no bigint, line string")


def test_event_lines(spark):
    lines = response(
        spark, ": hello", "data: a", "data:b\r", "", "event: x", "", "event:", "data: c", "", "",
        "event: y", "event: z", "data:  d", "other: e",
    )
    found = E.parse_sse_events(lines).orderBy("event_no").collect()
    assert [(r["event_type"], r["data"]) for r in found] == [
        ("message", "a\nb"), ("message", "c"), ("z", "d"),
    ]


def as_lines(rng, events):
    """Events written out with comments, other fields, carriage returns and gaps between them."""
    noise = [": keep", "id: 7", "retry: 5", "\r", ""]
    out = []
    for kind, parts in events:
        out += [rng.choice(noise) for _ in range(rng.randrange(3))]
        # A blank line may have ended nothing; the next event starts with its own name.
        block = [f"event: {kind}"] * (kind != "message")
        for part in parts:
            block += [": in between"] * rng.randrange(2) + [f"data: {part}"]
        out += ["", *[line + rng.choice(["", "\r"]) for line in block], rng.choice(["", "\r"])]
    return out


def test_random_events_are_read_back(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_ROWS", 5)
    rng = random.Random(11)
    drawn = {
        k: [
            (rng.choice(["message", "delta", "done"]), [rng.choice(["x", "y z", "{}"]) for _ in range(rng.randrange(1, 4))])
            for _ in range(rng.randrange(40))
        ]
        for k in "pqrs"
    }
    data = [(k, i, line) for k, events in drawn.items() for i, line in enumerate(as_lines(rng, events))]
    df = spark.createDataFrame(data, "response_id string, line_no bigint, line string")
    found = E.parse_sse_events(df).orderBy("event_no").collect()
    for k, events in drawn.items():
        got = [(r["event_type"], r["data"]) for r in found if r["response_id"] == k]
        assert got == [(kind, "\n".join(parts)) for kind, parts in events]


def test_folded_run(spark):
    def run(name, *events):
        return [(name, i, kind, data) for i, (kind, data) in enumerate(events)]

    answer = '{"content": [{"type": "text", "text": "first half"}, {"type": "text", "text": "rest"}]}'
    data = run(
        "ok",
        ("metadata", '{"metadata": {"role": "user", "message_id": 8}}'),
        ("metadata", '{"metadata": {"role": "user", "message_id": 9}}'),
        ("metadata", "broken"),
        ("metadata", '{"metadata": {"role": "assistant", "message_id": 70}}'),
        ("response", answer),
        ("response", "[1]"),
    ) + run("none", ("metadata", '{"metadata": {"role": "user", "message_id": 1}}'))
    df = spark.createDataFrame(data, "response_id string, event_no bigint, event_type string, data string")
    folded = {r["response_id"]: r for r in E.fold_agent_run(df).collect()}
    ok, none = folded["ok"], folded["none"]
    assert (ok["user_message_id"], ok["assistant_message_id"]) == (9, 70)
    assert (ok["assistant_text"], ok["status"]) == ("first half\nrest", "ok")
    assert (none["assistant_text"], none["status"]) == (None, "missing_final_response")


# --- reports and joins


def test_average_score_is_null_when_a_score_is(spark):
    schema = ", ".join(f"{m}_score double" for m in P.METRICS)
    df = spark.createDataFrame([(1.0, 0.5, 0.5, 0.0), (1.0, None, 1.0, 1.0)], schema)
    assert [r[0] for r in df.select(P.average_score()).collect()] == [0.5, None]


def test_fallback_output_replaces_missing_rows_only(spark):
    tickets = spark.createDataFrame([(1,), (2,)], "id int")
    outputs = spark.createDataFrame(
        [(1, None, "bug", "request", ["x"])],
        "id int, priority_level string, topic string, intent string, retrieved_context array<string>",
    )
    joined = L.with_fallback_output(tickets, outputs, "id")
    assert rows(joined, "id") == [
        (1, None, "bug", "request", ["x"]),
        (2, "UNKNOWN", "fallback", "fallback", []),
    ]


def test_tool_limits():
    assert [L.tool_limit(n) for n in [None, 0, 3, 50]] == [5, 5, 3, 10]
