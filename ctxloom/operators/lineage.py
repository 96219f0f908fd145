"""Cutting the lineage of tables that are read many times."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="ctxloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master without it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _temporary()


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
