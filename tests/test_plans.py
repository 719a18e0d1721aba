"""Plans: what is pushed down, limited before a shuffle, and never joined row by row."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from ticketmill.plans import registry

TABLES = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_joins(spark, key):
    text = plan(QUERIES[key](spark, TABLES))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("key", ["topk_per_query", "dedup_exact"])
def test_ranks_are_cut_before_the_shuffle(spark, key):
    text = plan(QUERIES[key](spark, TABLES))
    partial = text.index("Partial", text.index("WindowGroupLimit"))
    assert text.index("Exchange", text.index("WindowGroupLimit")) < partial


@pytest.mark.parametrize("key", ["list_conversations", "latest_one", "preview_limit"])
def test_small_limits_are_not_sorted_in_full(spark, key):
    assert "TakeOrderedAndProject" in plan(QUERIES[key](spark, TABLES))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["drop_intermediate"](spark, TABLES))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>" in text
    text = plan(QUERIES["filter_tag_equals"](spark, TABLES))
    assert "EqualTo(lang,en)" in text


def test_embedding_moves_no_rows(spark):
    from ticketmill.operators.retrieval import build_search_index

    df = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert "Exchange" not in plan(build_search_index(df, "doc_id", "text", ["lang"]))


def test_model_stage_ships_prompts_only(spark):
    from ticketmill.operators.inference import _answered

    df = spark.read.parquet(f"{TABLES}/documents.parquet")
    done = _answered(df, {"a": F.col("source")}, lambda: lambda prompts: prompts)
    assert plan(done).count("ArrowEvalPython") == 1


def test_prefixes_are_cut_without_repeating_the_expression(spark):
    text = plan(QUERIES["rewrite_answer"](spark, TABLES))
    assert text.count("regexp_replace") <= 4
