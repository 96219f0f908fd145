"""Shared helpers: work folders on shared storage, Arrow batches, packed hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes a batch may hold from the Parquet reader and on its way to Python; bounds memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

#: Rows that a join leaves to one task at one key, and the parts that finding heavy keys' rows is dealt over.
HEAVY, DEALT = 20_000, 64

_made: set[str] = set()
_local: list[str] = []


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, and make the package known to workers.

    Results are lazy, so the settings must still hold when they are computed;
    smaller values that the session has already are left alone.
    """
    ship(spark)
    for name, most in (("execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.columnarReaderBatchSize", BATCH_ROWS)):
        value = spark.conf.get(f"spark.sql.{name}", None)
        if value is None or not value.isdigit() or not 0 < int(value) <= most:
            spark.conf.set(f"spark.sql.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ctxloom-"))
    return _local[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


def staged(df: DataFrame, name: str, rows: int | None = None, per_file: int = 250_000, **options: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors.

    rows is an upper estimate where one is known: it keeps small tables in few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / per_file)))
    path = f"{shared_dir(spark).rstrip('/')}/ctxloom/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    _made.add(path)
    if len(_made) == 1:
        atexit.register(_remove_all, spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._ctxloom_path = path
    return back


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_ctxloom_path", None)
        if path in _made:
            _made.discard(path)
            _remove(df.sparkSession, path.rpartition("/")[0])


def _remove_all(spark: SparkSession) -> None:
    for path in _made:
        _remove(spark, path.rpartition("/")[0])


def hot_join(many: DataFrame, one: DataFrame, key: str | list[str], by: str, heavy: int | None = None) -> DataFrame:
    """Inner join of many rows a key (a staged table, or cheap to read twice) to at most one row a key.

    A key with more than `heavy` rows is dealt over as many parts as that takes,
    by the column `by`; its one row goes to each of them.
    """
    heavy, key = heavy or HEAVY, [key] if isinstance(key, str) else key
    sizes = many.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select(*key, F.ceil(F.col("_n") / heavy).cast("int").alias("_parts"))
    sizes = staged(sizes, "heavy", 1)
    if sizes.isEmpty():
        unstaged(sizes)
        return many.join(one, key)
    # the number of parts reaches a key's rows by a join that is dealt out as well
    every = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_first"))
    dealt = many.withColumn("_first", F.pmod(F.xxhash64(F.lit(11), F.col(by)), F.lit(DEALT)).cast("int")).join(every, [*key, "_first"], "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(F.lit(13), F.col(by)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_first", "_parts")
    copies = one.join(sizes, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*key, "_part"]).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Give free memory back at the end of a task: idle workers share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply f to every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out
        release()

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    """A batch of the given name=(values, type) columns."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
