"""Streams over the given files, run until everything is processed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.keyed import create_keyed_table, keyed_table
from ..sources.readers import load_new_files, stream_parquet
from ..sources.sinks import ensure_database
from ..streaming import tables as L
from . import frames as T
from .registry import query
from .state import ORDER, STATE

EVENTS = """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
    props string"""
MESSAGES = "conv_id bigint, turn bigint, role string, text string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stream(spark, tables, name: str, schema: str):
    # A source takes a single file by a pattern only; this one fits the file or folder of the name.
    return stream_parquet(spark, f"{tables}/{name}.parque[t]", schema)


def deliveries(spark, rows: list[DataFrame], schema: str) -> Iterator[DataFrame]:
    """Frames written as deliveries, a folder each, and after each one the stream to run."""
    root = scratch_path(spark, "deliveries")
    for number, frame in enumerate(rows):
        frame.write.parquet(f"{root}/delivery={number}")
        yield stream_parquet(spark, f"{root}/*", schema, files=1 << 30)


def in_three(frame, time: str):
    """Rows of the newer days, then the late ones, then all of the newer ones again."""
    new = F.col(time) >= F.to_timestamp_ntz(F.lit(T.SPLIT_AT))
    return [frame.filter(new), frame.filter(~new), frame.filter(new)]


def empty_table(spark, name: str, schema: str, keys: list[str]) -> str:
    path = scratch_path(spark, "live")
    database = f"live_{path.rsplit('-', 1)[1]}"
    ensure_database(spark, database, path)
    create_keyed_table(spark.createDataFrame([], schema), f"{database}.{name}", keys, n=0)
    return f"{database}.{name}"


@query("stream_ingest", "SELECT * FROM documents")
def stream_ingest(spark, tables):
    table, seen = scratch_path(spark, "documents"), scratch_path(spark, "seen")
    for _ in range(2):
        load_new_files(stream(spark, tables, "documents", DOCUMENTS), table, seen)
    return spark.read.schema(DOCUMENTS).parquet(table)


@query(
    "stream_dedup_messages",
    f"""SELECT event_id, ts, user_id,
           CASE WHEN ts >= TIMESTAMP '{T.SPLIT_AT}' THEN 2 ELSE 1 END AS snapshot, event_type
    FROM events""",
)
def stream_dedup_messages(spark, tables):
    """Three deliveries, the second one late and the third one a newer snapshot of the first."""
    rows = T.scan(spark, tables, "events").select("event_id", "ts", "user_id", "event_type")
    parts = [
        part.withColumn("snapshot", F.lit(number))
        for part, number in zip(in_three(rows, "ts"), [0, 1, 2])
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, snapshot int"
    keys = ["user_id", "event_id"]
    table = empty_table(spark, "messages", schema, keys)
    seen = scratch_path(spark, "seen")
    for source in deliveries(spark, parts, schema):
        L.keep_messages(source, keys, ["snapshot"], table, seen)
    return keyed_table(spark, table)


@query("stream_upsert_conversations", STATE)
def stream_upsert_conversations(spark, tables):
    """Updates in three deliveries, late ones and repeated ones among them."""
    schema = """conversation_id string, thread_id bigint, last_assistant_message_id bigint,
        origin_application string, updated_at timestamp_ntz, event_id bigint,
        created_at timestamp_ntz"""
    table = empty_table(spark, "conversations", schema, ["conversation_id"])
    seen = scratch_path(spark, "seen")
    for source in deliveries(spark, in_three(T.scan(spark, tables, "events"), "ts"), EVENTS):
        L.keep_conversations(T.as_conversation_updates(source), table, ORDER, seen)
    return keyed_table(spark, table).drop("event_id")


@query(
    "stream_conversation_state",
    """SELECT conv_id, max(turn + 1) FILTER (role = 'assistant') AS last_message_id,
           count(*) AS n_messages FROM conversations GROUP BY conv_id""",
)
def stream_conversation_state(spark, tables):
    """Last assistant message per conversation; the turns come in three deliveries, newest first."""
    rows = T.scan(spark, tables, "conversations")
    parts = [rows.filter(c) for c in ("turn >= 4", "turn < 2", "turn >= 2 and turn < 4")]
    table = empty_table(spark, "state", f"key bigint, {L.STATE}, expired boolean", ["key", "since"])
    answer = F.when(F.col("role") == "assistant", F.col("turn") + 1)
    seen = scratch_path(spark, "seen")
    for source in deliveries(spark, parts, MESSAGES):
        L.keep_last_message(source, "conv_id", answer, F.col("turn"), table, seen)
    return L.last_messages(spark, table).withColumnRenamed("key", "conv_id")


@query(
    "stream_index_refresh",
    """SELECT doc_id, lang AS language, true AS unit_length FROM documents
    WHERE regexp_matches(text, '[A-Za-zÀ-ÿ0-9]')""",
)
def stream_index_refresh(spark, tables):
    """Documents in three deliveries; the first one brings older texts of some, twice in a batch."""
    docs = T.scan(spark, tables, "documents")
    some = docs.filter("doc_id % 3 = 0")

    def earlier(word: str, order: int):
        text = F.concat(F.lit(f"{word} "), "text")
        return some.withColumns({"text": text, "n_chars": F.lit(order).cast("bigint")})

    parts = [earlier("older", 0).unionByName(earlier("oldest", -1)), docs, some]
    schema = "doc_id bigint, language string, digest string, embedding array<double>"
    table = empty_table(spark, "index", schema, ["doc_id"])
    seen = scratch_path(spark, "seen")
    for source in deliveries(spark, parts, DOCUMENTS):
        rows = source.withColumnRenamed("lang", "language")
        L.keep_index_fresh(rows, table, "doc_id", "text", ["language"], ["n_chars"], seen)
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v * v)
    return keyed_table(spark, table).select(
        "doc_id", "language", (F.abs(norm - 1) < 1e-9).alias("unit_length")
    )


# --- event time

DELAY = "2 days"
#: Days on which the second and the third delivery begin; a tenth of the rows comes one delivery later.
SECOND, THIRD = "2024-01-11 00:00:00", "2024-01-21 00:00:00"
DEALT = f"""dealt AS (
        SELECT *, least(2, CASE WHEN ts < TIMESTAMP '{SECOND}' THEN 0
                                WHEN ts < TIMESTAMP '{THIRD}' THEN 1 ELSE 2 END
                           + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS delivery
        FROM events),
    marks AS (
        SELECT n, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY} FROM dealt
                   WHERE delivery < n) AS mark FROM range(4) r(n))"""


def dealt(spark, tables) -> list[DataFrame]:
    """Events in three deliveries of ten days; a tenth of them comes one delivery too late."""
    def at(time: str):
        return F.to_timestamp_ntz(F.lit(time))

    day = F.when(F.col("ts") < at(SECOND), 0).when(F.col("ts") < at(THIRD), 1).otherwise(2)
    number = F.least(F.lit(2), day + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    events = T.scan(spark, tables, "events")
    return [events.filter(number == n) for n in range(3)]


def in_event_time(source: DataFrame) -> DataFrame:
    return source.withColumn("at", F.col("ts").cast("timestamp"))


WINDOWS = {"day": ("1 day", "1 day"), "half_day": ("12 hours", "6 hours")}


@query(
    "stream_activity_windows",
    f"""WITH {DEALT},
    placed AS (
        SELECT 'day' AS kind, date_trunc('day', ts)::TIMESTAMP AS window_start,
               date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type, delivery
        FROM dealt
        UNION ALL
        SELECT 'half_day', s, s + INTERVAL 12 HOUR, event_type, delivery
        FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts),
                                time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM dealt)),
    judged AS (
        SELECT kind, window_start, window_end, event_type,
               coalesce(window_end <= m.mark, false) AS late,
               window_end <= (SELECT mark FROM marks WHERE n = 3) AS closed
        FROM placed JOIN marks m ON m.n = delivery)
    SELECT kind, window_start, window_end, event_type, count(*) FILTER (NOT late) AS n,
           count(*) FILTER (late) AS n_late
    FROM judged WHERE closed GROUP BY ALL""",
)
def stream_activity_windows(spark, tables):
    """Events per closed window and type, in whole days and in half days that overlap.

    Beside what was counted in time stands what came too late for the window.
    """
    root = scratch_path(spark, "windows")
    by = ["event_type"]
    for source in deliveries(spark, dealt(spark, tables), EVENTS):
        rows = in_event_time(source)
        for kind, (length, slide) in WINDOWS.items():
            counted = L.activity_windows(rows, "at", DELAY, by, length, slide)
            load_new_files(counted, f"{root}/{kind}", f"{root}/seen-{kind}")

        def ends(batch: DataFrame) -> DataFrame:
            parts = []
            for kind, (length, slide) in WINDOWS.items():
                window = batch.select("*", F.lit(kind).alias("kind"), F.window("at", length, slide).alias("w"))
                parts.append(window.select("*", "w.start", F.col("w.end").alias("window_end")).drop("w"))
            return parts[0].unionByName(parts[1])

        L.keep_late(rows, "at", DELAY, ends, f"{root}/behind", f"{root}/seen-late")
    schema = "window_start timestamp, window_end timestamp, event_type string, n bigint"
    closed = [
        spark.read.schema(schema).parquet(f"{root}/{kind}").withColumn("kind", F.lit(kind)) for kind in WINDOWS
    ]
    late = L.late_rows(spark, f"{root}/behind").withColumnRenamed("start", "window_start")
    key = ["kind", "window_start", "window_end", "event_type"]
    missed = late.groupBy(*key).agg(F.count("*").alias("n_late"))
    zero = F.lit(0).cast("bigint")
    return closed[0].unionByName(closed[1]).join(missed, key, "full_outer").select(
        "kind",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "event_type",
        F.coalesce("n", zero).alias("n"),
        F.coalesce("n_late", zero).alias("n_late"),
    )


GAP = "1 hour"


def _sessions_sql() -> str:
    """Three rounds of what a stream does: add the rows in time, merge, give what is closed."""
    steps = []
    for n in range(3):
        earlier = f"SELECT user_id, ts FROM open{n - 1} UNION ALL " if n else ""
        steps.append(f"""pool{n} AS (
        {earlier}SELECT user_id, ts FROM dealt JOIN marks ON marks.n = delivery
        WHERE delivery = {n} AND coalesce(ts + INTERVAL {GAP} > mark, true)),
    numbered{n} AS (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
            SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {GAP}
                           THEN 0 ELSE 1 END AS fresh FROM pool{n})),
    spans{n} AS (
        SELECT user_id, s, min(ts) AS session_start, max(ts) + INTERVAL {GAP} AS session_end,
               count(*) AS n, max(ts) + INTERVAL {GAP} <= (SELECT mark FROM marks WHERE marks.n = {n + 1})
                   AS closed
        FROM numbered{n} GROUP BY ALL),
    open{n} AS (
        SELECT user_id, ts FROM numbered{n} JOIN spans{n} USING (user_id, s) WHERE NOT closed)""")
    closed = " UNION ALL ".join(
        f"SELECT user_id, session_start, session_end, n FROM spans{n} WHERE closed" for n in range(3)
    )
    return f"WITH {DEALT}, {', '.join(steps)} {closed}"


@query("stream_sessions", _sessions_sql())
def stream_sessions(spark, tables):
    """Closed sessions of every user; late rows that lie between two open sessions make them one."""
    table, seen = scratch_path(spark, "sessions"), scratch_path(spark, "seen")
    for source in deliveries(spark, dealt(spark, tables), EVENTS):
        sessions = L.activity_sessions(in_event_time(source), "at", DELAY, ["user_id"], GAP)
        load_new_files(sessions, table, seen)
    schema = "user_id bigint, session_start timestamp, session_end timestamp, n bigint"
    return spark.read.schema(schema).parquet(table).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    )
