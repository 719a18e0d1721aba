"""Sinks: catalog layers, overwrite, append, tables from queries, agent outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curate import upper_names
from ..session import cut_lineage, scratch_path
from .readers import TICKET_SCHEMA

LAYERS = {
    "raw": {"support_tickets": TICKET_SCHEMA},
    "curated": {},
    "services": {},
    "eval": {
        "runs": "run_id string, commit_sha string, model string, date timestamp_ntz",
    },
    "app": {
        "threads": """thread_id bigint, thread_name string, origin_application string,
            created_on timestamp_ntz, updated_on timestamp_ntz, ingested_at timestamp_ntz""",
        "thread_messages": """thread_id bigint, message_id bigint, parent_id bigint, role string,
            message_payload string, request_id string, created_on timestamp_ntz,
            ingested_at timestamp_ntz""",
        "conversations": """conversation_id string, thread_id bigint,
            last_assistant_message_id bigint, origin_application string,
            created_at timestamp_ntz, updated_at timestamp_ntz""",
        "agent_outputs": """output_id string, ticket_id string, issue_description string,
            predicted_priority string, retrieved_context array<string>, response string,
            created_at timestamp_ntz""",
        "chat_sessions": """session_id string, chat_history string,
            last_updated timestamp_ntz""",
    },
}


def create_layers(spark: SparkSession, prefix: str, location: str) -> None:
    """One database per layer with its typed tables, all below one location."""
    for layer, tables in LAYERS.items():
        database = f"{prefix}_{layer}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}/{database}.db'")
        for table, columns in tables.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet")


def drop_layers(spark: SparkSession, prefix: str) -> None:
    for layer in LAYERS:
        spark.sql(f"DROP DATABASE IF EXISTS {prefix}_{layer} CASCADE")


def ensure_database(spark: SparkSession, database: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")


def overwrite_table(df: DataFrame, table: str) -> None:
    """Replace a table, with column names in upper case as the warehouse keeps them."""
    upper_names(df).write.mode("overwrite").format("parquet").saveAsTable(table)


def append_table(df: DataFrame, table: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(table)


def create_table_as(spark: SparkSession, table: str, query: str, **frames: DataFrame) -> None:
    """Create or replace a table from a query; ``{name}`` in it stands for the frame given.

    The rows are written to a place of their own first. Only then is the name pointed there, so a
    query that fails leaves the old table, and a query may read the table it replaces. An existing table
    with the same columns gets its new place in one step. One with other columns is put aside under
    another name until the new one has its name, so no moment loses both.
    """
    path = scratch_path(spark, "table")
    spark.sql(query, **frames).write.parquet(path)
    rows = spark.read.parquet(path)
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}'")
    elif spark.table(table).dtypes == rows.dtypes:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        database, _, name = table.rpartition(".")
        new, old = (f"{database}.{name}_{kind}_{uuid.uuid4().hex[:8]}".lstrip(".") for kind in ("new", "old"))
        spark.sql(f"CREATE TABLE {new} USING parquet LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        spark.sql(f"DROP TABLE {old}")


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write a result to the shared folder once and read it from there.

    For steps that read it several times.
    """
    return cut_lineage(df, name)


def agent_output_rows(
    answers: DataFrame, output_id: Column | None = None, created_at: Column | None = None
) -> DataFrame:
    """Rows for the table of agent outputs: a new id and the UTC time of writing."""
    return answers.select(
        (F.uuid() if output_id is None else output_id).alias("output_id"),
        F.col("ticket_id").cast("string").alias("ticket_id"),
        "issue_description",
        F.col("priority_level").alias("predicted_priority"),
        "retrieved_context",
        F.col("final_response").alias("response"),
        (
            F.current_timestamp().cast("timestamp_ntz") if created_at is None else created_at
        ).alias("created_at"),
    )
