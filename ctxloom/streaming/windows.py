"""Decayed averages of events in tumbling windows, with a watermark for late rows."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources.storage import Storage


def decayed_windows(events: DataFrame, late: str = "1 day", width: str = "1 hour", tau: float = 5.0) -> DataFrame:
    """Weighted mean of value per event type and window; rows later than the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = e.withColumn("w", F.window("ts", width))
    weight = F.exp(-(F.unix_micros(F.col("w.end")) - F.unix_micros("ts")) / 86400e6 / tau)
    sums = grouped.groupBy("w", "event_type").agg(F.sum(weight * F.col("value")).alias("wv"), F.sum(weight).alias("ws"), F.count(F.lit(1)).alias("n_events"))
    return sums.select("event_type", F.col("w.start").alias("window_start"), F.try_divide("wv", "ws").alias("value"), "n_events")


def run_once(stream: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drive a stream over what is there into Parquet in the shared folder, and read that.

    Without keys the stream appends.  With keys it is an aggregation in update
    mode: a batch writes the groups it changed in a folder of its number, so a
    repeated batch replaces itself, and a group's row is that of its last batch.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/ctxloom-streams/{uuid.uuid4().hex}"
    out = f"{base}/rows"
    Storage(spark).make(out)
    atexit.register(_forget, spark, base)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if keys:
        writer = writer.outputMode("update").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", out)
    writer.start().awaitTermination()
    if not keys:
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(out)
    last = F.max_by(F.struct(*[F.col(c) for c in stream.columns if c not in keys]), "batch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*").select(*stream.columns)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        Storage(spark).delete(path)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


def decayed_windows_once(spark: SparkSession, path: str) -> DataFrame:
    """The windows over a Parquet table read as a stream."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return run_once(decayed_windows(events), ("event_type", "window_start"))
