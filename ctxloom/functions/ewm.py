"""Recursive exponential smoothing, y = (1-a) y + a x, decaying across nulls.

A null keeps the last value while its weight decays.  From one value to the next
the recurrence is y -> f y + b, so y is a running product and sum: with L the
running sum of ln f, y = e^L * (running sum of b e^-L).  Sums start anew whenever
L has fallen by DEPTH, where what came before weighs less than a double can hold
beside the last value, and go on from that value.  All of it are running window
sums: a row costs the same wherever it stands in its series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeatureSpec

DEPTH = 200.0


def with_smoothed(df: DataFrame, key: str, ts: str, plan: dict[str, tuple[str, float]]) -> DataFrame:
    """df with the exponentially weighted mean, up to and including each row, of every (input, alpha) under its name."""
    w = Window.partitionBy(key).orderBy(ts)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    columns = df.columns
    value = {n: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")) for n, (x, _) in plan.items()}
    df = df.select("*", F.row_number().over(w).alias("__row"), *[v.alias(f"__x_{n}") for n, v in value.items()])
    there = lambda n: F.when(F.col(f"__x_{n}").isNotNull(), F.col("__row"))
    df = df.select("*", *[F.last(there(n), True).over(earlier).alias(f"__at_{n}") for n in plan])
    steps, adds = [], []
    for n, (_, alpha) in plan.items():
        x, gap = F.col(f"__x_{n}"), F.col("__row") - F.col(f"__at_{n}")
        faded = F.exp(gap * math.log1p(-alpha)) if alpha < 1 else F.lit(0.0)
        # ln of faded / (faded + alpha); no less than -DEPTH, beyond which nothing of the last value is left
        step = F.greatest(gap * math.log1p(-alpha) - F.ln(faded + alpha), F.lit(-DEPTH)) if alpha < 1 else F.lit(-DEPTH)
        steps.append(F.when(x.isNotNull() & gap.isNotNull(), step).otherwise(0.0).alias(f"__f_{n}"))
        adds.append(F.when(gap.isNull(), x).otherwise(alpha * x / (faded + alpha)).alias(f"__b_{n}"))
    df = df.select(*columns, "__row", *steps, *adds)
    df = df.select("*", *[F.sum(f"__f_{n}").over(upto).alias(f"__l_{n}") for n in plan])
    for n in plan:
        log, block = F.col(f"__l_{n}"), F.floor(-F.col(f"__l_{n}") / DEPTH)
        df = df.withColumn("__block", block)
        within = Window.partitionBy(key, "__block").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        own = F.sum(F.col(f"__b_{n}") * F.exp(-(log + DEPTH * F.col("__block")))).over(within) * F.exp(log + DEPTH * F.col("__block"))
        df = df.withColumn("__own", own)
        # the value and L before the block; the sums of the block go on from there
        first = F.first(F.struct(F.col("__p_own").alias("y"), F.col("__p_log").alias("l"))).over(within)
        df = df.select("*", F.lag("__own").over(w).alias("__p_own"), F.lag(log).over(w).alias("__p_log")).withColumn("__before", first)
        carried = F.coalesce(F.col("__before.y") * F.exp(log - F.col("__before.l")), F.lit(0.0))
        df = df.withColumn(n, F.col("__own") + F.when(F.col("__block") > 0, carried).otherwise(0.0)).drop("__block", "__own", "__p_own", "__p_log", "__before")
    return df.select(*columns, *plan)


def span(n: int) -> float:
    return 2 / (n + 1)


def _plan(spec: FeatureSpec) -> dict[str, tuple[str, float]]:
    """Smoothed helper columns: name -> (input, alpha)."""
    fast, slow, _ = spec.macd
    out = {f"__ema{n}": ("close", span(n)) for n in spec.ema}
    out |= {"__fast": ("close", span(fast)), "__slow": ("close", span(slow))}
    return out | {"__gain": ("__up", 1 / spec.rsi), "__loss": ("__down", 1 / spec.rsi), "__atr": ("__tr", 1 / spec.atr)}


def ewm_columns(df: DataFrame, key: str, ts: str, spec: FeatureSpec) -> tuple[DataFrame, list[Column]]:
    """df with smoothed helpers, and the past-only features to select from it."""
    w = Window.partitionBy(key).orderBy(ts)
    df = with_smoothed(df, key, ts, _plan(spec)).withColumn("__line", F.col("__fast") - F.col("__slow"))
    df = with_smoothed(df, key, ts, {"__signal": ("__line", span(spec.macd[2]))}).drop("__line")
    gain, loss = F.col("__gain"), F.col("__loss")
    # the check for no gains comes last: a flat series has index 0
    rsi = F.when(gain == 0, 0.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    line = F.col("__fast") - F.col("__slow")
    past = lambda c: F.lag(c, 1).over(w)
    features = [past(F.col(f"__ema{n}")).alias(f"ema_{n}") for n in spec.ema]
    df = df.select("*", rsi.alias("__rsi"), line.alias("__line"), (line - F.col("__signal")).alias("__hist"))
    features += [past(F.col("__rsi")).alias(f"rsi_{spec.rsi}"), past(F.col("__line")).alias("macd"), past(F.col("__signal")).alias("macd_signal"), past(F.col("__hist")).alias("macd_hist")]
    return df, [*features, past(F.col("__atr")).alias(f"atr_{spec.atr}")]
