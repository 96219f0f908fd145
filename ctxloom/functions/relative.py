"""Features that place a target within its context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON


def relative_features(df: DataFrame, level_names: list[str], target: str) -> DataFrame:
    """zscore, ratio, pct_position and dev_from_mean of each level, where their inputs are there."""
    y, have = F.col(target), set(df.columns)
    out = []
    for name in level_names:
        stat = {s: f"{name}_{target}_{s}" for s in ("mean", "std", "median", "q25", "q75")}
        there = {s for s, c in stat.items() if c in have}
        c = {s: F.col(v) for s, v in stat.items()}
        if {"mean", "std"} <= there:
            out.append(F.try_divide(y - c["mean"], c["std"] + EPSILON).alias(f"{name}_{target}_zscore"))
        if "median" in there:
            out.append(F.try_divide(y, c["median"] + EPSILON).alias(f"{name}_{target}_ratio"))
        if {"q25", "q75"} <= there:
            out.append(F.try_divide(y - c["q25"], c["q75"] - c["q25"] + EPSILON).alias(f"{name}_{target}_pct_position"))
        if "mean" in there:
            out.append((y - c["mean"]).alias(f"{name}_{target}_dev_from_mean"))
    return df.select("*", *out)


def ratio_features(df: DataFrame, target: str, limit: float = 10.0) -> DataFrame:
    """target / statistic for every mean and median column, zero statistics as 1, clipped to +-limit."""
    out = []
    for name in df.columns:
        if name.endswith(("_mean", "_median")):
            ratio = F.try_divide(F.col(target), F.when(F.col(name) == 0, F.lit(1.0)).otherwise(F.col(name)))
            out.append(F.greatest(F.least(ratio, F.lit(limit)), F.lit(-limit)).alias(f"{name}_ratio"))
    return df.select("*", *out)
