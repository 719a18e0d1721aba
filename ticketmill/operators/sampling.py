"""Reproducible samples. The order of a hash of seed and id stands in for a random order."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..session import cut_lineage
from .sequences import number_rows

CELL_DIGITS = 4


def shuffle_key(id_column: str, seed: int = V.SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")))


def sample_n(df: DataFrame, n: int, id_column: str, seed: int = V.SEED) -> DataFrame:
    """n rows without replacement; all rows when there are fewer. The id is unique.

    The order of the hashes is cut into cells; counts tell which are taken whole, and only the one
    that holds the n-th row is ranked. Neither rows nor texts are sorted or pass through one task.
    """
    keyed = df.withColumn("_hash", shuffle_key(id_column, seed)).withColumn(
        "_cell", F.substring("_hash", 1, CELL_DIGITS)
    )
    # At most 16^4 rows.
    cells = cut_lineage(keyed.groupBy("_cell").agg(F.count("*").alias("_n")), "cells")
    earlier = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(n) - F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    taken = cells.withColumn("_left", left).filter("_left > 0")
    return _take(keyed, taken, ["_cell"], id_column).drop("_hash", "_cell")


def _take(keyed: DataFrame, taken: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """All rows of the cells that are taken whole, and the first ``_left`` of the others."""
    whole = taken.filter("_n <= _left").select(*keys)
    edge = taken.filter("_n > _left").select(*keys, "_left")
    in_cell = W.partitionBy(*keys).orderBy("_hash", id_column)
    cut = (
        keyed.join(edge, keys)
        .withColumn("_rn", F.row_number().over(in_cell))
        .filter("_rn <= _left")
        .drop("_rn", "_left")
    )
    return keyed.join(whole, keys, "left_semi").select(*keyed.columns).unionByName(cut.select(*keyed.columns))


def slice_rows(df: DataFrame, start: int, stop: int, order: list[str], out: str = "row_id") -> DataFrame:
    """Rows at positions [start, stop) of the order, numbered from 0 again."""
    rows = number_rows(df, order, out, start=0)
    return rows.filter((F.col(out) >= start) & (F.col(out) < stop)).withColumn(
        out, F.col(out) - start
    )


def sample_stratified(
    df: DataFrame,
    id_column: str,
    strata: list[str],
    per_combination: int = V.SAMPLES_PER_COMBINATION,
    seed: int = V.SEED,
    product_of_distincts: bool = False,
) -> DataFrame:
    """The same share of every stratum, at least one row, never more than the stratum has.

    share = per_combination * combinations / rows. ``product_of_distincts`` counts combinations as
    the product of the distinct values instead of those that occur. Null is a stratum of its own.

    A stratum may hold a large part of the table, so its rows are never ranked together. Their hash
    order is cut into 16^4 cells; cell counts tell which cells are taken whole, and only the rows
    of the one cell that holds the quota's edge are ranked. Exact for any quota.
    """
    keyed = df.withColumn("_hash", shuffle_key(id_column, seed)).withColumn(
        "_cell", F.substring("_hash", 1, CELL_DIGITS)
    )
    keys = [f"_s{i}" for i in range(len(strata))]
    for key, column in zip(keys, strata):
        keyed = keyed.withColumn(key, F.coalesce(F.col(column).cast("string"), F.lit("\0null")))

    # At most 16^4 rows per stratum, read three times below: written once instead of counted thrice.
    cells = cut_lineage(keyed.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")), "cells")
    per_stratum = cells.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    if product_of_distincts:
        # countDistinct skips nulls, as nunique does
        combinations = reduce(mul, [F.countDistinct(F.nullif(F.col(k), F.lit("\0null"))) for k in keys])
    else:
        combinations = F.count("*")
    share = per_stratum.agg(F.lit(per_combination) * combinations / F.sum("_size")).scalar()
    wanted = F.greatest(F.lit(1), F.floor(F.col("_size") * F.col("_share")))
    quotas = per_stratum.withColumn("_share", share).select(
        *keys, F.least(wanted, F.col("_size")).alias("_quota")
    )

    in_order = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    taken = (
        cells.withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0)))
        .join(quotas, keys)
        .filter("_before < _quota")
        .select(*keys, "_cell", "_n", (F.col("_quota") - F.col("_before")).alias("_left"))
    )
    return _take(keyed, taken, [*keys, "_cell"], id_column).drop(*keys, "_hash", "_cell")


def build_eval_set(
    df: DataFrame,
    id_column: str,
    strata: list[str],
    per_combination: int = V.SAMPLES_PER_COMBINATION,
    limit: int = V.EVAL_SAMPLE,
    seed: int = V.SEED,
) -> DataFrame:
    """Stratified sample, cut to the evaluation size, with a row number as ticket id."""
    sample = sample_stratified(df, id_column, strata, per_combination, seed)
    return slice_rows(
        sample_n(sample, limit, id_column, seed), 0, limit, [id_column], "ticket_id"
    )
