"""Readers of tables, lines, pairs and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_table(spark: SparkSession, name: str, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table's columns; filters put on it reach the files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_pairs(spark: SparkSession, path: str, fmt: str = "json", required: Sequence[str] = ("query", "positive")) -> DataFrame:
    """CSV with a header, or JSON lines, with at least the required columns; fails with the missing ones."""
    df = spark.read.option("header", True).format(fmt).load(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def parse_events(lines: DataFrame, schema: str, column: str = "value", most: int = 8_000) -> DataFrame:
    """Events out of JSON text, batch or stream; malformed and oversize ones are left out."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    first = schema.split()[0].strip("`:,")
    return lines.where(F.length(column) <= most).select(parsed.alias("e")).where(F.col(f"e.{first}").isNotNull()).select("e.*")


def file_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The parquet files of a directory as a stream, so many files a batch; without a number, all there are.

    Files that are not in the order of time need one batch where a job goes by a watermark: later batches drop what is
    behind it by then.
    """
    schema = spark.read.parquet(path).schema
    one = f"{path[:-1]}[{path[-1]}]"  # a pattern, as a stream takes a single file by a pattern only
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(one)


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """``file_stream`` of events, with ``ts`` as a time."""
    return file_stream(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp"))
