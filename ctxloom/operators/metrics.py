"""Accuracy of forecasts and returns of ranked portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def paired(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows where both are finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return df.where(ok(y) & ok(p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(p - y, 2)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def hit_rate(y: Column, p: Column) -> Column:
    """Share of equal signs; zero is a sign of its own."""
    return F.avg((F.signum(p) == F.signum(y)).cast("double"))


def accuracy(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    a, b = F.col(y), F.col(p)
    return paired(df, y, p).groupBy(*by).agg(rmse(a, b).alias("rmse"), mae(a, b).alias("mae"), hit_rate(a, b).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def across_folds(per_fold: DataFrame, by: list[str], names: tuple[str, ...] = ("rmse", "mae", "hit_rate")) -> DataFrame:
    """Mean and sample deviation of each metric over folds; one fold has deviation 0."""
    return per_fold.groupBy(*by).agg(*[x for n in names for x in (F.avg(n).alias(f"{n}_mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"{n}_std"))], F.count(F.lit(1)).alias("n_folds"))


def bins(r: Column, n: Column, most: int = 10) -> Column:
    """The quantile bin of rank r (from 1) among n, in whole numbers; least(most, n) bins."""
    b = F.least(F.lit(most), n)
    return F.when(n < 2, F.lit(0)).otherwise(F.greatest(F.expr("0"), F.ceil((r - 1) * b / F.when(n > 1, n - 1)) - 1).cast("int"))


def long_short(df: DataFrame, ts: str, pred: str, ret: str, tie: str, most: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean return of the top bin less that of the bottom bin per time; null below two rows."""
    ranked = paired(df, ret, pred)
    w = Window.partitionBy(*by, ts)
    ranked = ranked.select("*", F.row_number().over(w.orderBy(pred, tie)).alias("__r"), F.count(F.lit(1)).over(w).alias("__n"))
    ranked = ranked.withColumn("__bin", bins(F.col("__r"), F.col("__n"), most))
    top = F.least(F.lit(most), F.col("__n")) - 1
    top_mean = F.avg(F.when(F.col("__bin") == top, F.col(ret)))
    low_mean = F.avg(F.when(F.col("__bin") == 0, F.col(ret)))
    return ranked.groupBy(*by, ts).agg(F.when(F.first("__n") >= 2, top_mean - low_mean).alias("long_short"), F.first("__n").alias("n"))


def vanishing(std: Column, mean: Column) -> Column:
    return std < 1e-12 * F.greatest(F.lit(1.0), F.abs(mean))


def sharpe(r: Column) -> Column:
    """Annualised mean over sample deviation; null where the deviation vanishes."""
    m, s = F.avg(r), F.stddev_samp(r)
    return F.when(~vanishing(s, m), F.try_divide(m, s) * F.sqrt(F.lit(float(TRADING_DAYS))))


def sortino(r: Column) -> Column:
    """As sharpe over the deviation of negative returns; a single negative counts by its size, none gives null."""
    low = F.when(r < 0, r)
    n = F.count(low)
    down = F.when(n == 1, F.abs(F.max(low))).when(n > 1, F.stddev_samp(low))
    return F.when(~vanishing(down, F.avg(r)), F.try_divide(F.avg(r), down) * F.sqrt(F.lit(float(TRADING_DAYS))))


def portfolio(returns: DataFrame, by: list[str], r: str = "long_short") -> DataFrame:
    c = F.col(r)
    return returns.where(c.isNotNull()).groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), sharpe(c).alias("sharpe"), sortino(c).alias("sortino"), F.count(F.lit(1)).alias("n_periods"))


def select_horizon(scores: DataFrame, score: str, horizon: str = "horizon") -> DataFrame:
    """The horizon of the best score; ties, and no scores at all, go to the smallest."""
    return scores.orderBy(F.desc_nulls_last(score), horizon).limit(1).select(horizon, score)


def coverage(df: DataFrame, y: str, low: str, high: str, by: list[str]) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(*by).agg(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def improvement(base: Column, other: Column) -> Column:
    return F.try_divide(base - other, base) * 100


def comparison(base: DataFrame, other: DataFrame, on: list[str], names: tuple[str, ...] = ("rmse", "mae", "hit_rate")) -> DataFrame:
    """Metrics of both side by side with their differences; both must have the same keys."""
    if not base.select(*on).exceptAll(other.select(*on)).isEmpty() or not other.select(*on).exceptAll(base.select(*on)).isEmpty():
        raise ValueError("the two runs differ in their folds")
    b = base.select(*on, *[F.col(n).alias(f"base_{n}") for n in names])
    o = other.select(*on, *[F.col(n).alias(f"context_{n}") for n in names])
    return b.join(o, on).select("*", *[(F.col(f"context_{n}") - F.col(f"base_{n}")).alias(f"delta_{n}") for n in names])
