"""Profiles and reports: counts, lengths, score summaries."""

from __future__ import annotations

from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def mean6(column: str | Column) -> Column:
    return F.round(F.avg(column), 6)


def profile_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total rows and value counts of several columns in one pass: dimension, value, n."""
    sets = [[c] for c in columns] + [[]]
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    dimension, value = F.lit("total"), F.lit(None).cast("string")
    for c in columns:
        grouped = F.col(f"_g_{c}") == 0
        dimension = F.when(grouped, c).otherwise(dimension)
        value = F.when(grouped, F.col(c).cast("string")).otherwise(value)
    # value counts leave null values out
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n").filter(
        "dimension = 'total' or value is not null"
    )


#: Precision of the sketches: HLL errs by some 1 %, KLL by 1 % of the ranks.
HLL_BITS, KLL_K = 14, 256


def sketch_load(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, shortest, longest, hll, kll) of one load, a row per text column.

    The row is what later profiles need of the load: they merge rows of loads and read no texts again.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    )
    size = F.length("c.text").cast("bigint")
    return df.select(cells.alias("c")).groupBy("c.column").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("c.text").isNull()).alias("nulls"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
        F.hll_sketch_agg("c.text", HLL_BITS).alias("hll"),
        F.kll_sketch_agg_bigint(size, KLL_K).alias("kll"),
    )


def profile_from_sketches(sketches: DataFrame) -> DataFrame:
    """(column, n, nulls, shortest, longest, distinct, median) of all loads, from their sketches only.

    ``distinct`` and ``median`` are estimates, the others are exact.
    """
    merged = sketches.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_bigint("kll").alias("kll"),
    )
    return merged.select(
        "column", "n", "nulls", "shortest", "longest",
        F.hll_sketch_estimate("hll").alias("distinct"),
        F.when(F.col("n") > F.col("nulls"), F.kll_sketch_get_quantile_bigint("kll", F.lit(0.5))).alias("median"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns])


def profile_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, median, min, max of the text lengths, one row per column.

    Lengths are counted first: the exact median is then taken over distinct lengths with their
    frequencies, so its state grows with the longest text and not with the table.
    """
    lengths = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.length(c).alias("len")) for c in columns]
        )
    )
    histogram = (
        df.select(lengths.alias("p"))
        .select("p.column", "p.len")
        .filter("len is not null")
        .groupBy("column", "len")
        .agg(F.count("*").alias("n"))
    )
    return histogram.groupBy("column").agg(
        F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 6).alias("mean_length"),
        F.percentile("len", F.lit(0.5), F.col("n")).alias("median_length"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
    )


def count_distinct(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column and their product, which bounds the number of strata.

    ``approximate`` trades exactness for a fixed-size sketch per column.
    """
    count = F.approx_count_distinct if approximate else F.countDistinct
    counts = df.agg(*[count(c).alias(f"n_{c}") for c in columns])
    return counts.withColumn("n_product", reduce(mul, [F.col(f"n_{c}") for c in columns]))


def group_mean(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Means by key; rows without a key are left out."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[mean6(v).alias(f"mean_{v}") for v in values])
    )


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("count"),
        mean6(value).alias("avg_score"),
        F.min(value).alias("min_score"),
        F.max(value).alias("max_score"),
        F.round(F.stddev_samp(value), 6).alias("std_dev"),
    )


def pivot_first(
    df: DataFrame, keys: list[str], column: str, names: list[str], value: str, order: str
) -> DataFrame:
    """One row per key, one column per name, its first value by ``order``."""
    return df.groupBy(*keys).pivot(column, names).agg(F.min_by(value, order))


def average_score(metrics: list[str] = METRICS) -> Column:
    """Mean of the four metric scores of a row; null when one is missing."""
    return reduce(add, [F.col(f"{m}_score") for m in metrics]) / len(metrics)


def eval_summary(results: DataFrame, scores: list[str]) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_tickets"), *[mean6(s).alias(f"mean_{s}") for s in scores]
    )


def eval_breakdown(results: DataFrame, groups: list[str], scores: list[str]) -> DataFrame:
    """Mean of every score by each group column and overall, in one pass."""
    sets = [[F.col(g)] for g in groups] + [[]]
    summed = results.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.count("*").alias("n_tickets"),
        *[mean6(s).alias(f"mean_{s}") for s in scores],
        *[F.grouping(g).alias(f"_g_{g}") for g in groups],
    )
    dimension, value = F.lit("overall"), F.lit(None).cast("string")
    for g in groups:
        dimension = F.when(F.col(f"_g_{g}") == 0, g).otherwise(dimension)
        value = F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")).otherwise(value)
    return summed.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "n_tickets",
        *[f"mean_{s}" for s in scores],
    ).filter("dimension = 'overall' or value is not null")


def weakest_groups(breakdown: DataFrame, score: str, k: int) -> DataFrame:
    """The k lowest scoring groups; the overall row is no group."""
    return (
        breakdown.filter("dimension <> 'overall'")
        .orderBy(F.asc(score), "dimension", "value")
        .limit(k)
    )


def usage_summary(results: DataFrame, groups: list[str]) -> DataFrame:
    """Token means and the share of rows that searched, by group and overall."""
    searched = results.withColumn("used_search_share", F.col("used_search").cast("int"))
    return eval_breakdown(
        searched, groups, ["total_input_tokens", "total_output_tokens", "used_search_share"]
    )


def sanity_scores(results: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Per metric: smallest and largest score, and whether all scores are 0 or all are 1."""
    spread = results.agg(
        *[F.min(f"{m}_score").alias(f"{m}_min") for m in metrics],
        *[F.max(f"{m}_score").alias(f"{m}_max") for m in metrics],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.round(F.col(f"{m}_min"), 6).alias("min_score"),
                    F.round(F.col(f"{m}_max"), 6).alias("max_score"),
                )
                for m in metrics
            ]
        )
    )
    return (
        spread.select(rows.alias("r"))
        .select("r.*")
        .withColumn(
            "suspicious",
            (F.col("min_score") == F.col("max_score")) & F.col("min_score").isin(0.0, 1.0),
        )
    )
