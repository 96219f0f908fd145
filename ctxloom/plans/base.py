"""Shared pieces of the catalogue: rounding, fixture frames, SQL for statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import ORDER, QUANTILES
from ..sources.tables import table

__all__ = ["SQL_FOLD", "line_fold", "lines", "r", "rounded", "sql_r", "sql_stat", "table"]


def shift(n: int) -> float:
    return 3.7 * 10 ** -(n + 4)


def r(c: Column | str, n: int = 4) -> Column:
    """Rounded, without negative zero; the small shift keeps exact halves from rounding by summation order."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(shift(n)), n) + F.lit(0.0)


def sql_r(expr: str, n: int = 4) -> str:
    return f"round({expr} + {shift(n)!r}::DOUBLE, {n}) + 0.0"


def rounded(df: DataFrame, columns: Iterable[str], n: int = 4) -> DataFrame:
    """df with some columns rounded."""
    columns = set(columns)
    return df.select(*[r(c, n).alias(c) if c in columns else F.col(c) for c in df.columns])


def sql_stat(stat: str, y: str) -> str:
    """A statistic in DuckDB."""
    quantile = lambda p: f"quantile_cont({y}, {p})"
    plain = {
        "mean": f"avg({y})", "std": f"stddev_pop({y})", "var": f"var_pop({y})", "cv": f"stddev_pop({y}) / (avg({y}) + 1e-8)", "min": f"min({y})", "max": f"max({y})",
        "range": f"max({y}) - min({y})", "count": f"count({y})", "sum": f"coalesce(sum({y}), 0)", "median": quantile(0.5), "iqr": f"{quantile(0.75)} - {quantile(0.25)}",
    }
    return plain[stat] if stat in plain else quantile(ORDER[stat][0] if stat in QUANTILES else 0.5)


def line_fold() -> Column:
    """The fold of a line item, the same in both engines."""
    return ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 5).cast("int")


SQL_FOLD = "CAST((l_orderkey * 31 + l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 5 AS INTEGER)"


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*columns)
