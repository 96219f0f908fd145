"""Reading and writing: Parquet by name, commented CSV, partitioned stores, JSON results."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Storage


ARTICLES = "ticker string, published_at string, text string, source string"


def load_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, comment: str = "#", header: bool = True, separator: str = ",") -> DataFrame:
    """CSV whose lines after a comment mark are skipped; without a schema all columns are text."""
    reader = spark.read.option("comment", comment).option("header", header).option("sep", separator)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def seed_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from a commented CSV; times are UTC, unreadable ones leave their row out (see unreadable_articles)."""
    raw = read_csv(spark, path, ARTICLES)
    return raw.withColumn("published_at", F.try_to_timestamp("published_at")).where("published_at IS NOT NULL")


def unreadable_articles(spark: SparkSession, path: str) -> DataFrame:
    """The rows that seed_articles leaves out, with their time as it stands in the file."""
    return read_csv(spark, path, ARTICLES).where(F.try_to_timestamp("published_at").isNull())


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Listings from a commented CSV; unreadable dates are open ends."""
    raw = read_csv(spark, path, "ticker string, listed_at string, delisted_at string, name string")
    return raw.select("ticker", F.expr("try_to_date(listed_at)").alias("listed_at"), F.expr("try_to_date(delisted_at)").alias("delisted_at"), "name")


def write_partitioned(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Write a store partitioned by year and month of a timestamp."""
    df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).write.mode(mode).partitionBy("year", "month").parquet(path)


def read_partitioned(spark: SparkSession, path: str, columns: list[str], ts: str | None = None, start=None, end=None) -> DataFrame:
    """The store's own columns; a time range also prunes partitions."""
    df = spark.read.parquet(path)
    if ts and start is not None and end is not None:
        month = F.col("year") * 12 + F.col("month")
        at = lambda v: F.year(F.lit(v)) * 12 + F.month(F.lit(v))
        df = df.where(F.col(ts).between(F.lit(start), F.lit(end)) & month.between(at(start), at(end)))
    return df.select(*columns)


def session_closes(daily: DataFrame, sessions: DataFrame, day: str = "day") -> DataFrame:
    """Daily rows moved to the close of their session; days without a session are left out."""
    return daily.join(sessions.select(F.to_date("period_close_ts").alias(day), "period_close_ts"), day)


def write_json(data: dict, path: str, spark: SparkSession | None = None) -> None:
    Storage(spark).write_text(path, json.dumps(data, indent=1, default=str))


def append_json(record: dict, folder: str, spark: SparkSession | None = None) -> None:
    """Add a record to a folder of JSON lines, as a file of its own: writers do not meet, and spark.read.json reads the folder."""
    Storage(spark).write_text(f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(record, default=str) + "\n")


def append_missing(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Add the rows whose key a Parquet table lacks; returns what was added."""
    spark = df.sparkSession
    if Storage(spark).exists(path):
        df = df.join(spark.read.parquet(path).select(*key), key, "left_anti")
    df.write.mode("append").parquet(path)
    return df
