"""Sources and sinks with real files below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import short_id
from ..operators import curate as C
from ..operators import state as S
from ..operators.inference import classify_answer_type
from ..operators.rules import ANSWER_TYPE_KEYWORDS
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.keyed import create_keyed_table, keyed_table, replace_keys
from . import frames as T
from .evaluation import keyword_sql
from .frames import with_sql
from .registry import query
from .state import ORDER, STATE, halves


def fresh_database(spark, name: str) -> str:
    path = scratch_path(spark, name)
    database = f"{name}_{path.rsplit('-', 1)[1]}"
    K.ensure_database(spark, database, path)
    return database


def write_csv(df, path: str) -> None:
    """Ticket files in the dialect of the reader."""
    (
        df.write.mode("append")
        .options(
            header="true", quote='"', escape='"',
            ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
        )
        .csv(path)
    )


def ticket_files(spark, tables):
    """Documents in the columns of the raw ticket table, with the null tokens as answers."""
    token = (
        F.when(F.col("lang") == "de", "NULL").when(F.col("lang") == "fr", "null").otherwise("Null")
    )
    tags = [F.lit(None).cast("string").alias(f"tag_{i}") for i in range(3, 9)]
    return T.scan(spark, tables, "documents").select(
        F.col("doc_id"),
        F.concat(F.lit("  "), "source", F.lit("  ")).alias("subject"),
        F.concat(F.lit('"quoted", '), "text").alias("body"),
        token.alias("answer"),
        F.lit("Incident").alias("type"),
        F.col("source").alias("queue"),
        F.lit("high").alias("priority"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("version"),
        F.col("source").alias("tag_1"),
        F.lit("").alias("tag_2"),
        *tags,
    )


RAW_SQL = """SELECT source AS subject, '"quoted", ' || text AS body,
       CASE WHEN lang NOT IN ('de', 'fr') THEN 'Null' END AS answer, 'Incident' AS type,
       source AS queue, 'high' AS priority, lang AS language, n_chars AS version,
       source AS tag_1, NULL::VARCHAR AS tag_2, NULL::VARCHAR AS tag_3, NULL::VARCHAR AS tag_4,
       NULL::VARCHAR AS tag_5, NULL::VARCHAR AS tag_6, NULL::VARCHAR AS tag_7,
       NULL::VARCHAR AS tag_8
FROM documents"""


@query("scan_csv_tickets", RAW_SQL)
def scan_csv_tickets(spark, tables):
    path = scratch_path(spark, "tickets-csv")
    write_csv(ticket_files(spark, tables).drop("doc_id"), path)
    return R.scan_csv_tickets(spark, path)


@query("ingest_once", RAW_SQL)
def ingest_once(spark, tables):
    """Two deliveries and a repeated run: every file is loaded once."""
    stage, table, seen = (scratch_path(spark, n) for n in ["stage", "raw", "seen"])
    files = ticket_files(spark, tables)
    labels = T.scan(spark, tables, "labels")
    for kind in ["left_semi", "left_anti"]:
        write_csv(files.join(labels, "doc_id", kind).drop("doc_id"), stage)
        R.load_new_files(R.stream_csv_tickets(spark, stage), table, seen)
    R.load_new_files(R.stream_csv_tickets(spark, stage), table, seen)
    return spark.read.parquet(table)


@query("scan_table_lower", "SELECT * FROM customer")
def scan_table_lower(spark, tables):
    view = f"customer_{uuid.uuid4().hex[:8]}"
    C.upper_names(T.scan(spark, tables, "customer")).createOrReplaceTempView(view)
    return R.scan_table(spark, view)


@query(
    "scan_csv_infer",
    "SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
)
def scan_csv_infer(spark, tables):
    path = scratch_path(spark, "suppliers-csv")
    write_csv(T.scan(spark, tables, "supplier"), path)
    return R.scan_csv_infer(spark, path)


@query("sink_overwrite", "SELECT * FROM part")
def sink_overwrite(spark, tables):
    table = f"{fresh_database(spark, 'curated')}.parts"
    rows = T.scan(spark, tables, "part")
    K.overwrite_table(rows.select("p_partkey"), table)
    K.overwrite_table(rows, table)
    return R.scan_table(spark, table)


@query("sink_append", "SELECT * FROM labels")
def sink_append(spark, tables):
    table = f"{fresh_database(spark, 'app')}.labels"
    rows = T.scan(spark, tables, "labels")
    K.append_table(rows.filter("quality = 1"), table)
    K.append_table(rows.filter("quality <> 1"), table)
    return spark.table(table)


@query(
    "sink_ctas",
    with_sql("pairs")
    + """ SELECT answer_type, count(*) AS n FROM (SELECT """
    + keyword_sql("answer", ANSWER_TYPE_KEYWORDS, "PARTIAL")
    + " AS answer_type FROM answered) GROUP BY answer_type",
)
def sink_ctas(spark, tables):
    table = f"{fresh_database(spark, 'curated')}.tickets_classified"
    classified = classify_answer_type(T.answered_tickets(spark, tables))
    K.create_table_as(spark, table, "SELECT ticket_id, answer_type FROM {classified}", classified=classified)
    return spark.table(table).groupBy("answer_type").agg(F.count("*").alias("n"))


@query(
    "sink_staged",
    """WITH sized AS (SELECT lang, length(text) AS size FROM documents),
    mean AS (SELECT avg(size) AS m FROM sized)
    SELECT lang, count(*) FILTER (size > m) AS longer FROM sized, mean GROUP BY lang""",
)
def sink_staged(spark, tables):
    sized = K.staged(
        T.scan(spark, tables, "documents").select("lang", F.length("text").alias("size"))
    )
    longer = sized.withColumn("m", sized.agg(F.avg("size")).scalar())
    return longer.groupBy("lang").agg(F.count_if(F.col("size") > F.col("m")).alias("longer"))


@query("sink_upsert", STATE)
def sink_upsert(spark, tables):
    """A named table brought up to date by two upserts, one after the other."""
    table = f"{fresh_database(spark, 'app')}.conversations"
    key = ["conversation_id"]
    known, updates = halves(spark, tables)
    create_keyed_table(known, table, key)

    def merge(old, changes):
        return S.upsert_conversations(old, changes, ORDER)

    earlier = F.col("updated_at") < F.to_timestamp_ntz(F.lit("2024-01-24 00:00:00"))
    for part in (updates.filter(earlier), updates.filter(~earlier)):
        replace_keys(table, part, merge)
    return keyed_table(spark, table)


@query(
    "sink_agent_outputs",
    """SELECT md5(conv_id || '-' || turn) AS output_id, conv_id || '-' || turn AS ticket_id,
           text AS issue_description, 'LOW' AS predicted_priority, role AS response,
           TIMESTAMP '2024-02-01 00:00:00' AS created_at, substr(md5(conv_id || '-' || turn), 1, 8) AS short_id
    FROM conversations""",
)
def sink_agent_outputs(spark, tables):
    table = f"{fresh_database(spark, 'app')}.agent_outputs"
    answers = T.scan(spark, tables, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("ticket_id"),
        F.col("text").alias("issue_description"),
        F.lit("LOW").alias("priority_level"),
        F.array("role").alias("retrieved_context"),
        F.col("role").alias("final_response"),
    )
    # Ids and times are fixed here so that the rows can be checked; the defaults are uuid and now.
    rows = K.agent_output_rows(
        answers, F.md5("ticket_id"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    )
    K.append_table(rows, table)
    return spark.table(table).drop("retrieved_context").withColumn(
        "short_id", short_id(F.col("output_id"))
    )


@query(
    "ddl_layers",
    """SELECT 'raw.support_tickets' AS table_name, count(*) AS n FROM documents
    UNION ALL SELECT 'app.thread_messages', count(*) FROM conversations
    UNION ALL SELECT 'app.conversations', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'app.threads', 0 UNION ALL SELECT 'app.agent_outputs', 0
    UNION ALL SELECT 'app.chat_sessions', 0 UNION ALL SELECT 'eval.runs', 0""",
)
def ddl_layers(spark, tables):
    """Create all layers, fill three tables, count all of them, drop everything."""
    path = scratch_path(spark, "layers")
    prefix = f"t{path.rsplit('-', 1)[1]}"
    K.create_layers(spark, prefix, path)
    nothing = F.lit(None)
    filled = {
        "raw.support_tickets": ticket_files(spark, tables).drop("doc_id"),
        "app.thread_messages": T.messages(spark, tables).select(
            F.col("conv_id").alias("thread_id"),
            "message_id",
            F.col("turn").alias("parent_id"),
            "role",
            F.col("text").alias("message_payload"),
            nothing.cast("string").alias("request_id"),
            nothing.cast("timestamp_ntz").alias("created_on"),
            nothing.cast("timestamp_ntz").alias("ingested_at"),
        ),
        "app.conversations": T.conversations(T.conversation_updates(spark, tables)).select(
            "conversation_id", "thread_id", "last_assistant_message_id", "origin_application",
            "created_at", "updated_at",
        ),
    }
    for name, rows in filled.items():
        rows.write.insertInto(f"{prefix}_{name}")
    counts = None
    for layer, names in K.LAYERS.items():
        for name in names:
            n = spark.table(f"{prefix}_{layer}.{name}").agg(F.count("*").alias("n"))
            row = n.select(F.lit(f"{layer}.{name}").alias("table_name"), "n")
            counts = row if counts is None else counts.unionByName(row)
    counted = K.staged(counts, "counts")
    K.drop_layers(spark, prefix)
    return counted
