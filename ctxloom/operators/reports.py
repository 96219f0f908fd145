"""Rollups of results: importances, winners, pivots, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def importance_summary(rows: DataFrame, feature: str = "feature", value: str = "importance", strategy: str = "strategy") -> DataFrame:
    """Per feature: mean, spread, percentiles, how often, and in which strategies."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(feature).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"), p.alias("p"),
        F.array_join(F.sort_array(F.collect_set(strategy)), "|").alias("strategies"),
    )
    return out.select(feature, "mean", "std", "n", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "strategies")


def pivoted(rows: DataFrame, by: list[str], across: str, value: str, names: list, how: str = "mean") -> DataFrame:
    """One column per name; names are given, so no extra job looks for them."""
    agg = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[how]
    return rows.groupBy(*by).pivot(across, names).agg(agg(value))


def top_by_group(rows: DataFrame, by: list[str], value: str, tie: list[str], k: int = 1, largest: bool = True) -> DataFrame:
    """The k best rows per group, ties by key."""
    w = Window.partitionBy(*by).orderBy(F.desc(value) if largest else F.asc(value), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def win_counts(rows: DataFrame, contest: list[str], entrant: str, score: str) -> DataFrame:
    """How often each entrant has the lowest score."""
    return top_by_group(rows, contest, score, [entrant], 1, False).groupBy(entrant).agg(F.count(F.lit(1)).alias("wins"))


def mean_ranks(rows: DataFrame, contest: list[str], entrant: str, score: str, k: int = 10) -> DataFrame:
    """The k best mean ranks over contests."""
    w = Window.partitionBy(*contest).orderBy(score, entrant)
    ranked = rows.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy(entrant).agg(F.avg("__r").alias("mean_rank"), F.count(F.lit(1)).alias("contests")).orderBy("mean_rank", entrant).limit(k)


def dominance(rows: DataFrame, value: str, tie: str, k: int = 3, limit: float = 0.7) -> DataFrame:
    """Share of the k largest values, and whether it is above the limit."""
    top = rows.orderBy(F.desc(value), tie).limit(k).agg(F.sum(value).alias("top"))
    whole = rows.agg(F.sum(value).alias("total"))
    return top.crossJoin(F.broadcast(whole)).select(F.try_divide("top", "total").alias("top_share"), (F.try_divide("top", "total") > limit).alias("dominated"))  # one row each


def rollup_table(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def target_profile(rows: DataFrame, y: str, probs: tuple[float, ...]) -> DataFrame:
    """(probability, value) of the target's exact percentiles, without gathering the target in one task."""
    from ..functions.aggregates import quantiles_of

    p = quantiles_of(rows, [], y, probs)
    return p.select(F.posexplode("__p").alias("k", "value")).select(F.get(F.array(*map(F.lit, probs)), F.col("k")).alias("probability"), "value")


def split_summary(rows: DataFrame, split: str, y: str) -> DataFrame:
    return rows.groupBy(split).agg(F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.count(y).alias("n"))


def split_differences(rows: DataFrame, split: str, y: str, sides: tuple[str, str] = ("train", "test")) -> DataFrame:
    """One row: how far mean and deviation of y lie apart between two sides of a split."""
    of = lambda f, s: f(F.when(F.col(split) == s, F.col(y)))
    return rows.agg(*[F.abs(of(f, sides[0]) - of(f, sides[1])).alias(n) for n, f in (("mean_difference", F.avg), ("std_difference", F.stddev_samp))])


def feature_usage(results: DataFrame, features: str, score: str, tie: str, k: int = 20) -> DataFrame:
    """How many of the k best results use each feature."""
    best = results.orderBy(score, tie).limit(k)
    return best.select(F.explode(features).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n_results"))
