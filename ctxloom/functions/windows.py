"""Past-only window features of a panel: row t sees rows strictly before t.

Every builder returns Columns over one window specification, so a whole feature
set is a single select with one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import FeatureSpec, LagSpec
from .ewm import ewm_columns


def panel(key: str = "ticker", ts: str = "period_close_ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def full(x: Column, w: WindowSpec, n: int, value: Column) -> Column:
    """value where all n previous x are there, else null."""
    return F.when(F.count(x).over(w.rowsBetween(-n, -1)) == n, value)


def log_return(close: Column, w: WindowSpec, n: int = 1, shift: int = 0) -> Column:
    return F.ln(F.try_divide(F.lag(close, shift).over(w) if shift else close, F.lag(close, shift + n).over(w)))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) in floating point: infinite where one of both is 0, NaN where both are or their signs differ; null only beside a null."""
    ratio = F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))
    return F.when(ratio == 0, float("-inf")).when(ratio < 0, float("nan")).otherwise(F.ln(ratio))


def with_log_ratios(df: DataFrame, keep: tuple[str, ...], ratios: dict[str, tuple[Column, Column]]) -> DataFrame:
    """keep, and the log_ratio of every pair of window columns under its name; each window column is computed once."""
    sides = df.select(*keep, *[c.alias(f"__{side}_{n}") for n, pair in ratios.items() for side, c in zip("ab", pair, strict=True)])
    return sides.select(*keep, *[log_ratio(F.col(f"__a_{n}"), F.col(f"__b_{n}")).alias(n) for n in ratios])


def past_mean(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, F.avg(x).over(w.rowsBetween(-n, -1)))


def past_std(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, F.stddev_samp(x).over(w.rowsBetween(-n, -1)))


def returns(close: str, w: WindowSpec, windows: tuple[int, ...]) -> list[Column]:
    """ret_{n}d_log: log of the previous value over the one n rows earlier; null where that is not finite."""
    return [log_return(F.col(close), w, n, 1).alias(f"ret_{n}d_log") for n in windows]


def sma(close: str, w: WindowSpec, windows: tuple[int, ...]) -> list[Column]:
    return [past_mean(F.col(close), w, n).alias(f"sma_{n}") for n in windows]


def volatility(log_ret: str, w: WindowSpec, windows: tuple[int, ...]) -> list[Column]:
    """Sample deviation of the previous n one-step log returns; log_ret is a column of them."""
    return [past_std(F.col(log_ret), w, n).alias(f"volatility_{n}") for n in windows]


def volume_zscore(volume: str, w: WindowSpec, n: int) -> Column:
    v, frame = F.col(volume), w.rowsBetween(-n, -1)
    return full(v, w, n, F.try_divide(F.lag(v, 1).over(w) - F.avg(v).over(frame), F.stddev_samp(v).over(frame))).alias(f"volume_zscore_{n}")


def bollinger(close: str, w: WindowSpec, n: int, k: float) -> list[Column]:
    mid, band = past_mean(F.col(close), w, n), past_std(F.col(close), w, n)
    return [mid.alias("bb_mid"), (mid + k * band).alias("bb_upper"), (mid - k * band).alias("bb_lower")]


def lags(columns: list[str], w: WindowSpec, spec: LagSpec) -> list[Column]:
    """{c}_lag{n}, {c}_rollmean{n}, {c}_rollstd{n} of every column and window."""
    out = []
    for c in columns:
        for n in spec.windows:
            made = {"lag": lambda c=c, n=n: F.lag(F.col(c), n).over(w), "rollmean": lambda c=c, n=n: past_mean(F.col(c), w, n), "rollstd": lambda c=c, n=n: past_std(F.col(c), w, n)}
            out += [made[m]().alias(f"{c}_{m}{n}") for m in spec.methods]
    return out


def forward_targets(close: str, w: WindowSpec, horizons: tuple[int, ...]) -> list[Column]:
    """ret_h{N}: log of the value N rows ahead over this one; null at the end and where that is not finite."""
    return [F.ln(F.try_divide(F.lead(F.col(close), n).over(w), F.col(close))).alias(f"ret_h{n}") for n in horizons]


def add_technical_features(prices: DataFrame, spec: FeatureSpec = FeatureSpec(), key: str = "ticker", ts: str = "period_close_ts") -> DataFrame:
    """All technical features in two steps over one partitioning: helpers, then features."""
    w = panel(key, ts)
    close = F.col("close")
    change = close - F.lag(close, 1).over(w)
    previous = F.lag(close, 1).over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))
    helped = prices.select("*", log_return(close, w).alias("__lr"), F.greatest(change, F.lit(0.0)).alias("__up0"), F.greatest(-change, F.lit(0.0)).alias("__down0"), change.alias("__change"), true_range.alias("__tr"))
    helped = helped.select("*", F.when(F.col("__change").isNotNull(), F.col("__up0")).alias("__up"), F.when(F.col("__change").isNotNull(), F.col("__down0")).alias("__down"))
    smoothed, names = ewm_columns(helped, key, ts, spec)
    out = smoothed.select(
        *prices.columns, *returns("close", w, spec.returns), *sma("close", w, spec.sma), *names,
        *volatility("__lr", w, spec.volatility), volume_zscore("volume", w, spec.volume_z), *bollinger("close", w, *spec.bollinger),
    )
    return out


def apply_lags(df: DataFrame, columns: list[str], spec: LagSpec = LagSpec(), key: str = "ticker", ts: str = "period_close_ts") -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df.select("*", *lags(columns, panel(key, ts), spec))
