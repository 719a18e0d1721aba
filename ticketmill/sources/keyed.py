"""Keyed tables: Parquet tables in folders and buckets by key, brought up to date by upserts.

A keyed table is a view over a table of files. The files lie in folders by a hash of the key, so that an
upsert rewrites only the folders its changes touch, and inside a folder in buckets by the key, so that
the join with the changes moves the changes only and every bucket has a writer of its own. The number of
folders and of buckets both grow with the square root of the table's size. A table that has outgrown its
shape is written anew, and the view is pointed to the new files in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

FOLDER = "_folder"
#: Rows that a file of a bucket in a folder should have, and files that the smallest table has.
FILE_ROWS = 250_000
LEAST_FILES = 4
#: A table is written anew once its files hold so many times the rows they should.
OUTGROWN = 4

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def shape(rows: int, file_rows: int = FILE_ROWS) -> tuple[int, int]:
    """(folders, buckets) for so many rows, both powers of two, buckets the larger ones."""
    files = max(LEAST_FILES, -(-rows // file_rows))
    bits = (files - 1).bit_length()
    return 1 << bits // 2, 1 << bits - bits // 2


def _placed(rows: DataFrame, keys: list[str], folders: int) -> DataFrame:
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    at = F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")
    # A row without a key could never be found again.
    return rows.withColumn(FOLDER, F.when(whole, at).otherwise(F.raise_error(F.lit("a key is null"))))


def _write(rows: DataFrame, table: str, keys: list[str], file_rows: int, n: int, room: int = 0) -> None:
    """Files for the rows, and for ``room`` more, then the view over them."""
    spark = rows.sparkSession
    folders, buckets = shape(n + room, file_rows)
    base = f"{table}__{uuid.uuid4().hex[:8]}"
    columns = rows.columns
    (
        _placed(rows, keys, folders)
        .repartition(buckets, *keys)  # the hash of the buckets: one writer for each
        .write.format("parquet")
        .partitionBy(FOLDER)
        .bucketBy(buckets, *keys)
        .option("path", scratch_path(spark, "table"))
        .saveAsTable(base)
    )
    names = ", ".join(f"`{c}`" for c in columns)
    facts = {"base": base, "keys": ",".join(keys), "folders": folders, "buckets": buckets}
    facts |= {"file_rows": file_rows, "rows": n}
    properties = ", ".join(f"'{k}' = '{v}'" for k, v in facts.items())
    spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ({properties}) AS SELECT {names} FROM {base}")


def _facts(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def create_keyed_table(
    rows: DataFrame, table: str, keys: list[str], file_rows: int = FILE_ROWS, n: int | None = None
) -> None:
    """A table of rows that are unique by their keys, none of which may be null; ``n`` if it is known."""
    if n is None:
        rows = cut_lineage(rows, "rows")
        n = rows.count()
    _write(rows, table, keys, file_rows, n)


def keyed_table(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now."""
    spark.catalog.refreshTable(_facts(spark, table)["base"])
    return spark.table(table)


def _merged(facts: dict[str, str], changes: DataFrame, merge: Merge) -> tuple[int, DataFrame]:
    """How many changes there are, and what the folders that they touch will hold."""
    placed = _placed(changes, facts["keys"].split(","), int(facts["folders"]))
    # At most one row per folder.
    touched = placed.groupBy(FOLDER).agg(F.count("*").alias("n")).collect()
    folders = [r[FOLDER] for r in touched]
    old = changes.sparkSession.table(facts["base"]).filter(F.col(FOLDER).isin(folders)).drop(FOLDER)
    return sum(r["n"] for r in touched), merge(old, changes)


def merged_rows(table: str, changes: DataFrame, merge: Merge) -> DataFrame:
    """What the folders that the changes touch will hold: ``merge(their rows, changes)``."""
    return _merged(_facts(changes.sparkSession, table), changes, merge)[1]


def replace_keys(table: str, changes: DataFrame, merge: Merge) -> None:
    """Bring ``merge(old rows, changes)`` into a keyed table.

    Only the folders that the changes touch are read and written; Spark swaps them when the whole write
    is committed, so a failing merge or write leaves the table as it was, and the same changes may come
    again. ``merge`` may not change a key, and may give at most one row for each row it gets; a join on
    the keys keeps the table's side where it is.
    """
    spark = changes.sparkSession
    facts = _facts(spark, table)
    base, keys, folders = facts["base"], facts["keys"].split(","), int(facts["folders"])
    spark.catalog.refreshTable(base)
    changes = cut_lineage(changes, "changes")
    shaped = folders * int(facts["buckets"]) * int(facts["file_rows"])
    arriving = changes.count()
    if arriving > shaped:
        # More than the table was made for: a merge has one task per bucket, so the buckets come first.
        whole = spark.table(base).drop(FOLDER)
        _write(whole, table, keys, int(facts["file_rows"]), int(facts["rows"]), room=arriving)
        facts = _facts(spark, table)
        base, folders = facts["base"], int(facts["folders"])
    n, merged = _merged(facts, changes, merge)
    if not n:
        return
    columns = [c for c in spark.table(base).columns if c != FOLDER]
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode, "static")
    spark.conf.set(mode, "dynamic")  # a table takes it from the session only
    try:
        _placed(merged.select(*columns), keys, folders).write.mode("overwrite").insertInto(base)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(base)
    # Rows at most: some changes replace rows. They are counted once the table may have outgrown its shape.
    rows, file_rows = int(facts["rows"]) + n, int(facts["file_rows"])
    capacity = OUTGROWN * folders * int(facts["buckets"]) * file_rows
    if rows > capacity:
        whole = spark.table(base).drop(FOLDER)
        rows = whole.count()
        if rows > capacity:
            _write(whole, table, keys, file_rows, rows)
            return
    spark.sql(f"ALTER VIEW {table} SET TBLPROPERTIES ('rows' = '{rows}')")


def newer(keys: list[str], order: list[str], first: list[str] | None = None) -> Merge:
    """A merge that keeps, of the old and the new row of a key, the later one by ``order``.

    The new row wins a tie. Columns in ``first`` keep the smaller value of both.
    """
    first = first or []

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in keys]
        sides = [
            side.select(*keys, F.struct(*rest).alias(name)) for side, name in ((old, "_o"), (new, "_n"))
        ]
        o, n = F.col("_o"), F.col("_n")

        def at(side: Column) -> Column:
            return F.struct(*[side[c].alias(c) for c in order]) if order else F.lit(0)

        take = o.isNull() | (n.isNotNull() & (at(n) >= at(o)))
        joined = sides[0].join(sides[1], keys, "full_outer").withColumn("_r", F.when(take, n).otherwise(o))
        return joined.select(
            *keys,
            *[(F.least(o[c], n[c]) if c in first else F.col("_r")[c]).alias(c) for c in rest],
        )

    return merge
