"""Selection, cleaning, de-duplication and sampling of tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import curate as C
from ..operators import sampling as S
from ..operators.relate import topk_per_group
from . import frames as T
from .frames import with_sql
from .registry import query


@query(
    "select_columns_by_rule",
    with_sql("tickets")
    + " SELECT ticket_id, subject, body, answer, queue, language, tag_1, tag_2 FROM tickets",
)
def select_columns_by_rule(spark, tables):
    return C.select_columns_by_rule(T.tickets(spark, tables))


@query(
    "filter_min_length",
    with_sql("tickets")
    + """ SELECT ticket_id, length(body) AS body_length, length(answer) AS answer_length
    FROM tickets WHERE length(body) >= 50 AND length(answer) >= 50""",
)
def filter_min_length(spark, tables):
    kept = C.filter_min_length(T.tickets(spark, tables), ["body", "answer"])
    return kept.select(
        "ticket_id",
        F.length("body").cast("bigint").alias("body_length"),
        F.length("answer").cast("bigint").alias("answer_length"),
    )


@query(
    "filter_length_band",
    with_sql("tickets")
    + """ SELECT count(*) FILTER (length(body) >= 50 AND length(body) < 100) AS body_in_range,
           count(*) FILTER (length(answer) >= 50 AND length(answer) < 100) AS answer_in_range,
           count(*) FILTER (length(body) >= 50 AND length(body) < 100
                            AND length(answer) >= 50 AND length(answer) < 100) AS both_in_range
    FROM tickets""",
)
def filter_length_band(spark, tables):
    return C.length_band_counts(T.tickets(spark, tables), "body", "answer")


@query(
    "rename_case",
    """SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME", c_nationkey AS "C_NATIONKEY",
           c_acctbal AS "C_ACCTBAL", c_mktsegment AS "C_MKTSEGMENT" FROM customer""",
)
def rename_case(spark, tables):
    return C.upper_names(T.scan(spark, tables, "customer"))


@query("drop_intermediate", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def drop_intermediate(spark, tables):
    working = [
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    return T.scan(spark, tables, "lineitem").drop(*working)


@query(
    "filter_attributes",
    with_sql("tickets", "labelled_tickets")
    + """ SELECT ticket_id, language, type, priority FROM labelled_tickets
    WHERE language = 'en' AND type = 'Incident' AND priority = 'high'""",
)
def filter_attributes(spark, tables):
    from ..operators.retrieval import filter_attributes as keep

    rows = T.labelled_tickets(spark, tables).select("ticket_id", "language", "type", "priority")
    return keep(rows, language="en", type="Incident", priority="high")


@query("filter_roles", "SELECT * FROM conversations WHERE role IN ('user', 'assistant')")
def filter_roles(spark, tables):
    return T.scan(spark, tables, "conversations").filter(F.col("role").isin("user", "assistant"))


@query(
    "filter_tag_equals",
    with_sql("records") + f" SELECT * FROM records WHERE tags = '{T.RUN}'",
)
def filter_tag_equals(spark, tables):
    return T.records(spark, tables).filter(F.col("tags") == T.RUN)


@query(
    "default_missing_column",
    with_sql("tickets") + " SELECT ticket_id, language, 'N/A' AS priority FROM tickets",
)
def default_missing_column(spark, tables):
    rows = T.tickets(spark, tables).select("ticket_id", "language")
    for column in ["language", "priority"]:
        rows = C.default_missing_column(rows, column)
    return rows


@query(
    "dedup_exact",
    with_sql("tickets")
    + " SELECT min(ticket_id) AS ticket_id, body, answer FROM tickets GROUP BY body, answer",
)
def dedup_exact(spark, tables):
    rows = T.tickets(spark, tables).select("ticket_id", "body", "answer")
    return C.dedup_exact(rows, ["body", "answer"], ["ticket_id"])


@query(
    "keep_latest_snapshot",
    with_sql("snapshots")
    + """ SELECT * EXCLUDE (newest) FROM (
        SELECT *, max(ingested_at) OVER (PARTITION BY thread_id) AS newest FROM snapshots)
    WHERE ingested_at = newest""",
)
def keep_latest_snapshot(spark, tables):
    return C.keep_latest_snapshot(T.snapshots(spark, tables), ["thread_id"])


@query(
    "dedup_stats",
    with_sql("tickets")
    + """, kept AS (SELECT DISTINCT body, answer FROM tickets
                    WHERE length(body) >= 50 AND length(answer) >= 50),
    n AS (SELECT (SELECT count(*) FROM tickets) AS a, (SELECT count(*) FROM kept) AS b)
    SELECT a AS original_tickets, b AS cleaned_tickets, a - b AS removed_tickets,
           round((a - b) / a * 100, 6) AS removal_percentage FROM n""",
)
def dedup_stats(spark, tables):
    return C.dedup_stats(T.tickets(spark, tables), ["body", "answer"])


def _stratified_sql(combos: str) -> str:
    return (
        with_sql("tickets", "labelled_tickets")
        + f""",
    sized AS (
        SELECT ticket_id, type, priority, language,
               count(*) OVER (PARTITION BY type, priority, language) AS n,
               row_number() OVER (PARTITION BY type, priority, language
                                  ORDER BY md5('{V.SEED}|' || ticket_id), ticket_id) AS rn
        FROM labelled_tickets),
    share AS (SELECT {V.SAMPLES_PER_COMBINATION} * {combos} / count(*) AS f FROM labelled_tickets),
    sampled AS (
        SELECT ticket_id, type, priority, language FROM sized, share
        WHERE rn <= least(greatest(1, floor(n * f)), n))"""
    )


OCCURRING = "count(DISTINCT (type, priority, language))"
PRODUCT = "count(DISTINCT type) * count(DISTINCT priority) * count(DISTINCT language)"


@query("sample_stratified", _stratified_sql(OCCURRING) + " SELECT * FROM sampled")
def sample_stratified(spark, tables):
    rows = T.labelled_tickets(spark, tables).select("ticket_id", *V.STRATIFY_COLUMNS)
    return S.sample_stratified(rows, "ticket_id", V.STRATIFY_COLUMNS)


@query("sample_stratified_product", _stratified_sql(PRODUCT) + " SELECT * FROM sampled")
def sample_stratified_product(spark, tables):
    rows = T.labelled_tickets(spark, tables).select("ticket_id", *V.STRATIFY_COLUMNS)
    return S.sample_stratified(
        rows, "ticket_id", V.STRATIFY_COLUMNS, product_of_distincts=True
    )


@query(
    "sample_n",
    with_sql("tickets")
    + f""" SELECT ticket_id, language FROM tickets
    ORDER BY md5('{V.SEED}|' || ticket_id), ticket_id LIMIT {V.CURATED_SAMPLE}""",
)
def sample_n(spark, tables):
    rows = T.tickets(spark, tables).select("ticket_id", "language")
    return S.sample_n(rows, V.CURATED_SAMPLE, "ticket_id")


@query(
    "slice_rows",
    with_sql("tickets")
    + """ SELECT row_id - 2 AS row_id, ticket_id FROM (
        SELECT ticket_id, row_number() OVER (ORDER BY ticket_id) - 1 AS row_id FROM tickets)
    WHERE row_id >= 2 AND row_id < 5""",
)
def slice_rows(spark, tables):
    rows = T.tickets(spark, tables).select("ticket_id")
    return S.slice_rows(rows, 2, 5, ["ticket_id"])


@query(
    "build_eval_set",
    _stratified_sql(OCCURRING)
    + f""", cut AS (
        SELECT ticket_id AS source_id, type, priority, language FROM sampled
        ORDER BY md5('{V.SEED}|' || ticket_id), ticket_id LIMIT {V.EVAL_SAMPLE})
    SELECT row_number() OVER (ORDER BY source_id) - 1 AS ticket_id, * FROM cut""",
)
def build_eval_set(spark, tables):
    rows = T.labelled_tickets(spark, tables).select(
        F.col("ticket_id").alias("source_id"), *V.STRATIFY_COLUMNS
    )
    return S.build_eval_set(rows, "source_id", V.STRATIFY_COLUMNS)


@query("preview_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_limit(spark, tables):
    return T.scan(spark, tables, "orders").orderBy("o_orderkey").limit(5)


@query(
    "order_multi",
    """SELECT o_orderkey, o_orderdate, o_orderpriority,
           row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS position
    FROM orders""",
)
def order_multi(spark, tables):
    from ..operators.sequences import number_rows

    rows = T.scan(spark, tables, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return number_rows(rows, ["o_orderdate", "o_orderpriority", "o_orderkey"], "position")


@query("latest_one", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_one(spark, tables):
    return T.scan(spark, tables, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


@query(
    "topk_per_query",
    f"""SELECT user_id, rank, event_id, value FROM (
        SELECT user_id, event_id, value,
               row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
        FROM events) WHERE rank <= {V.TOP_K}""",
)
def topk_per_query(spark, tables):
    rows = T.scan(spark, tables, "events").select("user_id", "event_id", "value")
    return topk_per_group(rows, ["user_id"], [F.desc("value"), F.col("event_id")], V.TOP_K)


@query(
    "ingest_qa",
    with_sql("tickets")
    + " SELECT count(*) AS n_rows, "
    + ", ".join(
        f"count(*) FILTER ({c} IS NULL) AS {c}_nulls"
        for c in ["ticket_id", "body", "answer", "queue", "language"]
    )
    + " FROM tickets",
)
def ingest_qa(spark, tables):
    from ..sources.readers import ingest_qa as check

    return check(T.tickets(spark, tables).select("ticket_id", "body", "answer", "queue", "language"))
