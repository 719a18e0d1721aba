"""Scans: tables, ticket files, file streams that load each file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.curate import lower_names

TICKET_SCHEMA = """subject string, body string, answer string, type string, queue string,
    priority string, language string, version bigint, tag_1 string, tag_2 string, tag_3 string,
    tag_4 string, tag_5 string, tag_6 string, tag_7 string, tag_8 string"""
NULL_TOKENS = ["NULL", "null", ""]

CSV_DIALECT = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def scan_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table, or Parquet files for anything with a slash; column names in lower case."""
    df = spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)
    return lower_names(df)


def null_tokens(df: DataFrame) -> DataFrame:
    """Exactly ``NULL``, ``null`` and the empty text become null in text columns."""

    def cell(name: str) -> Column:
        return F.when(~F.col(name).isin(NULL_TOKENS), F.col(name)).alias(name)

    texts = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[cell(c) if c in texts else F.col(c) for c in df.columns])


def csv_options(line_breaks: bool) -> dict[str, str]:
    """``line_breaks``: values may hold line breaks. Spark cannot split such a file, so a file is a
    task; without them a large file is read in as many splits as its size asks for."""
    return {**CSV_DIALECT, "multiLine": str(line_breaks).lower()}


def scan_csv_tickets(
    spark: SparkSession, path: str, schema: str | StructType = TICKET_SCHEMA, line_breaks: bool = True
) -> DataFrame:
    """Ticket files with a declared schema: a wrong value is null, a wrong row does not shift."""
    return null_tokens(spark.read.schema(schema).options(**csv_options(line_breaks)).csv(path))


def scan_csv_infer(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """An ad-hoc read with types taken from the data, which costs a second pass."""
    return spark.read.options(**csv_options(line_breaks), inferSchema="true").csv(path)


def stream_csv_tickets(
    spark: SparkSession, path: str, schema: str | StructType = TICKET_SCHEMA, line_breaks: bool = True
) -> DataFrame:
    return null_tokens(spark.readStream.schema(schema).options(**csv_options(line_breaks)).csv(path))


def stream_parquet(
    spark: SparkSession, path: str, schema: str | StructType, files: int = 1000
) -> DataFrame:
    """New Parquet files as a stream, ``files`` at a time; a folder or a pattern of folders."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def load_new_files(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append what the stream has not delivered before to Parquet files, then stop.

    The checkpoint remembers the files read and the sink's log the batches written, so running it
    again, or after a failure, adds nothing twice.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_qa(df: DataFrame) -> DataFrame:
    """Row count and null counts after a load, in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns],
    )
