"""Ordered work inside a key, and row numbers, without putting one key or table into one task.

A window partitioned by the key alone would sort a whole conversation in one task, however long it
is. Here a key is cut into blocks of its order column: each block is a window of bounded size, and
only one summary row per block is put in order across the key. The order column is a whole number,
unique inside its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 4096


def _blocked(df: DataFrame, order: str, size: int | None) -> DataFrame:
    return df.withColumn("_block", F.expr(f"`{order}` div {size or BLOCK_ROWS}"))


def _carry(
    blocked: DataFrame, keys: list[str], summary: Column, over_blocks, local: Column, combine, out: str
) -> DataFrame:
    """Join each block's view of the blocks around it to the block-local result."""
    blocks = (
        blocked.groupBy(*keys, "_block")
        .agg(summary.alias("_summary"))
        .withColumn("_carry", over_blocks(F.col("_summary")))
        .select(*keys, "_block", "_carry")
    )
    return (
        blocked.withColumn("_local", local)
        .join(blocks, [*keys, "_block"])
        .withColumn(out, combine(F.col("_local"), F.col("_carry")))
        .drop("_block", "_local", "_carry")
    )


def last_before(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, size: int | None = None
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its key."""
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return _carry(
        _blocked(df, order, size),
        keys,
        F.max_by(value, F.when(value.isNotNull(), F.col(order))),
        lambda c: F.last(c, ignorenulls=True).over(across),
        F.last(value, ignorenulls=True).over(inside),
        F.coalesce,
        out,
    )


def next_after(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, size: int | None = None
) -> DataFrame:
    """First non-null ``value`` strictly after each row of its key."""
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(1, W.unboundedFollowing)
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(1, W.unboundedFollowing)
    return _carry(
        _blocked(df, order, size),
        keys,
        F.min_by(value, F.when(value.isNotNull(), F.col(order))),
        lambda c: F.first(c, ignorenulls=True).over(across),
        F.first(value, ignorenulls=True).over(inside),
        F.coalesce,
        out,
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, size: int | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows of the key strictly before each row."""
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return _carry(
        _blocked(df, order, size),
        keys,
        F.sum(value),
        lambda c: F.sum(c).over(across),
        F.sum(value).over(inside),
        lambda local, carry: F.coalesce(local, zero) + F.coalesce(carry, zero),
        out,
    )


def number_rows(df: DataFrame, order: list[str | Column], out: str, start: int = 1) -> DataFrame:
    """Consecutive row numbers over the whole table; ``order`` must be unique.

    A range shuffle puts the rows in order across partitions, each partition counts its own, and the
    offsets (one row per partition) are joined back. Writing the rows fixes which got which place.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn(
        "_inner", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # One row per partition of the range shuffle: bounded by the shuffle width, not by the data.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_inner") + F.lit(start).cast("bigint"))
        .drop("_place", "_part", "_inner", "_offset")
    )
