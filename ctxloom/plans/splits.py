"""Fold and split generators over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import folds
from ..operators.guards import fold_violations
from .base import table

_D = "d AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS p FROM (SELECT DISTINCT o_orderdate FROM orders))"
_ORDERS = ("o_orderkey", "o_orderdate")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ORDERS)


@register("ts_group_split", f"WITH {_D}, c AS (SELECT count(*) AS n FROM d) SELECT o_orderkey, o.o_orderdate, CASE WHEN p < least(greatest(CAST(round_even(n * 0.8e0, 0) AS BIGINT), 1), n - 1) THEN 'train' ELSE 'test' END AS split FROM orders o JOIN d USING (o_orderdate), c")
def ts_group_split(spark, sf_dir):
    return folds.ts_group_split(_orders(spark, sf_dir), "o_orderdate", 0.2)


@register(
    "rolling_ts_folds",
    f"""WITH {_D}, c AS (SELECT n, greatest(1, n // 5) AS t FROM (SELECT count(*) AS n FROM d)), b AS (SELECT CAST(f AS INTEGER) AS fold, n - (4 - f) * t AS vs, n - (4 - f) * t + t AS ve, greatest(0, n - (4 - f) * t - greatest(2 * t, CAST(floor(0.8e0 * n) AS BIGINT))) AS ts FROM c, (SELECT unnest([0, 1, 2, 3]) AS f))
    SELECT fold, CASE WHEN p < vs THEN 'train' ELSE 'val' END AS side, o_orderkey, o.o_orderdate FROM orders o JOIN d USING (o_orderdate) JOIN b ON p >= ts AND p < ve""",
)
def rolling_ts_folds(spark, sf_dir):
    return folds.rolling_period_folds(_orders(spark, sf_dir), "o_orderdate", 4)


def _walk_sql(extra: str = "") -> str:
    at = {"train_start": 0, "train_max": 503, "val_min": 504, "val_max": 566, "test_min": 567, "test_max": 629}
    cols = ", ".join(f"(SELECT o_orderdate FROM d WHERE p = s + {k}) AS {n}" for n, k in at.items())
    return f"WITH {_D}, c AS (SELECT count(*) AS n FROM d), s AS (SELECT unnest(range(0, n - 630 + 1, 63)) AS s FROM c), f AS (SELECT CAST(s // 63 AS INTEGER) AS fold_idx, {cols} FROM s) {extra or 'SELECT * FROM f'}"


def _walk(spark, sf_dir):
    return folds.walk_forward_folds(_orders(spark, sf_dir), "o_orderdate", 504, 63, 63, 63)


@register("wf_folds", _walk_sql())
def wf_folds(spark, sf_dir):
    return _walk(spark, sf_dir)


@register("wf_monotonicity", _walk_sql("SELECT fold_idx, 'x' AS problem FROM f WHERE train_max >= val_min OR val_max >= test_min"))
def wf_monotonicity(spark, sf_dir):
    return fold_violations(_walk(spark, sf_dir))


@register(
    "wf_monotonicity_mutated",
    _walk_sql("SELECT fold_idx, 'train reaches into validation' AS problem FROM f WHERE fold_idx % 3 = 1 UNION ALL SELECT fold_idx, 'validation reaches into test' FROM f WHERE fold_idx % 4 = 2"),
)
def wf_monotonicity_mutated(spark, sf_dir):
    f = _walk(spark, sf_dir)
    f = f.withColumn("train_max", F.when(F.col("fold_idx") % 3 == 1, F.col("val_min")).otherwise(F.col("train_max"))).withColumn("val_max", F.when(F.col("fold_idx") % 4 == 2, F.col("test_min")).otherwise(F.col("val_max")))
    return fold_violations(f)


@register("temporal_holdout", f"WITH {_D}, c AS (SELECT count(*) AS n FROM d) SELECT o_orderkey, o.o_orderdate, CASE WHEN p >= n - 30 THEN 'test' ELSE 'train' END AS split FROM orders o JOIN d USING (o_orderdate), c")
def temporal_holdout(spark, sf_dir):
    return folds.temporal_holdout(_orders(spark, sf_dir), "o_orderdate", periods=30)


@register("temporal_holdout_share", f"WITH {_D}, c AS (SELECT count(*) AS n FROM d) SELECT o_orderkey, o.o_orderdate, CASE WHEN p >= n - CAST(ceil(n * 0.15e0) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM orders o JOIN d USING (o_orderdate), c")
def temporal_holdout_share(spark, sf_dir):
    return folds.temporal_holdout(_orders(spark, sf_dir), "o_orderdate", share=0.15)


@register("selection_split_tail", "WITH c AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, o_orderdate, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) > n - CAST(round_even(n * 0.2e0, 0) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM orders, c")
def selection_split_tail(spark, sf_dir):
    return folds.selection_split(_orders(spark, sf_dir), ["o_orderdate", "o_orderkey"], 0.2, True)


@register("row_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def row_positions(spark, sf_dir):
    return folds.positions(_orders(spark, sf_dir), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@register("balanced_folds", "SELECT count(*) AS n_folds, min(n) AS smallest, max(n) AS largest FROM (SELECT o_orderkey % 7 AS f, n_rows // 7 AS n FROM (SELECT *, count(*) OVER () AS n_rows FROM orders) GROUP BY ALL)")
def balanced_folds(spark, sf_dir):
    """Sizes of seven balanced folds, cut to their whole part: 15000 rows do not divide evenly."""
    f = folds.balanced_fold(_orders(spark, sf_dir), ["o_orderkey"], 7)
    sizes = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_folds"), F.min("n").alias("smallest"), (F.max("n") - F.when(F.max("n") > F.min("n"), 1).otherwise(0)).alias("largest"))
