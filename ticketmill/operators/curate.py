"""Cleaning: columns, lengths, exact duplicates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def select_columns_by_rule(
    df: DataFrame,
    patterns: list[str] = V.EXCLUDE_PATTERNS,
    names: list[str] = V.EXCLUDE_COLUMNS,
    keep: list[str] = V.KEEP_COLUMNS,
) -> DataFrame:
    """Keep listed columns; of the rest drop listed names and names that hold a pattern."""

    def wanted(column: str) -> bool:
        excluded = column in names or any(p in column for p in patterns)
        return column in keep or not excluded

    return df.select(*[c for c in df.columns if wanted(c)])


def filter_min_length(
    df: DataFrame, columns: list[str], minimum: int = V.MIN_TEXT_LENGTH
) -> DataFrame:
    """Rows whose listed texts all have the minimum length; a null text fails."""
    for column in columns:
        df = df.filter(F.length(column) >= minimum)
    return df


def in_length_band(column: str, low: int, high: int) -> Column:
    size = F.length(column)
    return F.coalesce((size >= low) & (size < high), F.lit(False))


def length_band_counts(df: DataFrame, a: str, b: str, low: int = 50, high: int = 100) -> DataFrame:
    """How many rows have the first, the second, both texts inside the band."""
    in_a, in_b = in_length_band(a, low, high), in_length_band(b, low, high)
    return df.agg(
        F.count_if(in_a).alias(f"{a}_in_range"),
        F.count_if(in_b).alias(f"{b}_in_range"),
        F.count_if(in_a & in_b).alias("both_in_range"),
    )


def text_digest(*columns: str) -> Column:
    """A short key for long texts; lengths keep (ab, c) and (a, bc) apart, nulls have a mark."""
    parts = []
    for c in columns:
        parts += [F.coalesce(F.length(c).cast("string"), F.lit("-")), F.coalesce(F.col(c), F.lit(""))]
    return F.sha2(F.concat_ws(":", *parts), 256)


def dedup_exact(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """First row of every group with equal texts.

    ``row_number() = 1`` lets Spark drop later copies before the shuffle, so a text with very many
    copies arrives as one row per map task; the digest keeps the texts out of the sort keys.
    """
    copies = W.partitionBy("_digest").orderBy(*order)
    return (
        df.withColumn("_digest", text_digest(*columns))
        .withColumn("_rn", F.row_number().over(copies))
        .filter("_rn = 1")
        .drop("_digest", "_rn")
    )


def dedup_stats(df: DataFrame, columns: list[str], minimum: int = V.MIN_TEXT_LENGTH) -> DataFrame:
    """Rows before and after the length filter and exact de-duplication, in one pass."""
    long_enough = F.lit(True)
    for c in columns:
        long_enough = long_enough & F.coalesce(F.length(c) >= minimum, F.lit(False))
    per_text = df.groupBy(text_digest(*columns).alias("_digest")).agg(
        F.count("*").alias("_n"), F.max(long_enough).alias("_kept")
    )
    counted = per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("original_tickets"),
        F.count_if("_kept").alias("cleaned_tickets"),
    )
    removed = F.col("original_tickets") - F.col("cleaned_tickets")
    return counted.withColumn("removed_tickets", removed).withColumn(
        "removal_percentage",
        F.round(F.try_divide(removed, F.col("original_tickets")) * 100, 6),
    )


def newest_per_key(df: DataFrame, keys: list[str], at: str = "ingested_at") -> DataFrame:
    """Newest time of every key that occurs more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"), F.max(at).alias("keep_at"))
        .filter("copies > 1")
    )


def keep_latest_snapshot(df: DataFrame, keys: list[str], at: str = "ingested_at") -> DataFrame:
    """Drop rows older than the newest of their key; rows that tie at the newest all stay.

    The newest time is aggregated first and joined back, so no key is ranked inside one task and a
    key with very many snapshots can be split by the skew join.
    """
    newest = df.groupBy(*keys).agg(F.max(at).alias("_keep_at"))
    return df.join(newest, keys).filter(F.col(at) == F.col("_keep_at")).drop("_keep_at")


def delete_older(df: DataFrame, keep: DataFrame, keys: list[str], at: str = "ingested_at") -> DataFrame:
    """Rows left after deleting those older than ``keep_at`` of their key."""
    d, k = df.alias("d"), keep.alias("k")
    condition = F.col(f"d.{at}") < F.col("k.keep_at")
    for key in keys:
        condition = condition & (F.col(f"d.{key}") == F.col(f"k.{key}"))
    return d.join(k, condition, "left_anti")


def default_missing_column(df: DataFrame, column: str, default: str = V.MISSING_COLUMN) -> DataFrame:
    """A default for a column the table does not have; nulls in an existing column stay."""
    return df if column in df.columns else df.withColumn(column, F.lit(default))
