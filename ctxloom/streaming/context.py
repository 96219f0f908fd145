"""Context of streamed rows from a fitted store: a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ContextSpec
from ..operators.context import ContextEstimator, ContextModel
from .windows import run_once


def enrich_stream(stream: DataFrame, model: ContextModel) -> DataFrame:
    """Join the store to rows as they come; cardinalities are those of the fit, as a stream has none of its own."""
    if model.cardinality is None:
        raise ValueError("freeze the model's cardinalities first")
    return model.transform(stream, finish=False)


def enrich_once(spark: SparkSession, path: str) -> DataFrame:
    """Orders enriched as a stream by the context of their priorities."""
    static = spark.read.parquet(path)
    model = ContextEstimator(ContextSpec("o_totalprice", ("o_orderpriority",), ("mean", "count"), strategy="off")).fit(static)
    model.cardinality = {"o_orderpriority": static.agg(F.count_distinct("o_orderpriority")).first()[0]}
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", name).parquet(folder)
    return run_once(enrich_stream(stream, model).select("o_orderkey", "o_orderpriority_o_totalprice_mean", "o_orderpriority_o_totalprice_count"))
