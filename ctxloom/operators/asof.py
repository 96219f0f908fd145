"""Binding events to the first session that closes at or after them, and decayed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_WEIGHT = 1e-6


def sessions_of(prices: DataFrame, ts: str = "period_close_ts") -> DataFrame:
    """(period_close_ts, previous_close) of all distinct closes, over all tickers."""
    closes = prices.select(F.col(ts).alias("period_close_ts")).where(F.col(ts).isNotNull()).distinct()
    # one row per session ever held: a calendar, small whatever the panel's size
    return closes.withColumn("previous_close", F.lag("period_close_ts").over(Window.orderBy("period_close_ts")))


def bind_forward(articles: DataFrame, sessions: DataFrame, published: str = "published_at", early_to_first: bool = False) -> DataFrame:
    """articles with period_close_ts, the first close at or after publication; later ones than the last close are dropped.

    Without early_to_first, articles before the first session are dropped unless
    published at its close; with it they bind to it.  The search is an equi-join
    on the hour, so neither side is crossed and a busy day is many keys: each
    session offers itself in the hours since the one before it, each article
    asks in its hour.
    """
    hour = lambda c: F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)
    first = sessions.where("previous_close IS NULL").select("period_close_ts")
    later = sessions.where("previous_close IS NOT NULL")
    offered = later.select("*", F.explode(F.sequence(hour("previous_close"), hour("period_close_ts"))).alias("__hour"))
    asked = articles.withColumn("__hour", hour(published))
    bound = asked.join(offered, (asked["__hour"] == offered["__hour"]) & (F.col(published) > F.col("previous_close")) & (F.col(published) <= F.col("period_close_ts")))
    out = bound.select(*articles.columns, "period_close_ts")
    opening = articles.crossJoin(F.broadcast(first.limit(1)))  # one row
    opening = opening.where(F.col(published) <= F.col("period_close_ts") if early_to_first else F.col(published) == F.col("period_close_ts"))
    return out.unionByName(opening.select(*articles.columns, "period_close_ts"))


def dropped_articles(articles: DataFrame, sessions: DataFrame, published: str = "published_at") -> DataFrame:
    """Articles that bind to no session, with the reason."""
    span = sessions.agg(F.min("period_close_ts").alias("__first"), F.max("period_close_ts").alias("__last"))
    both = articles.crossJoin(F.broadcast(span))  # one row
    reason = F.when(F.col(published) > F.col("__last"), "after last session").when(F.col(published) < F.col("__first"), "before first session")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").drop("__first", "__last")


def age_days(published: str, close: str):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(close) - micros(published)) / F.lit(86400e6)


def decayed(scored: DataFrame, values: list[str], by: list[str], tau: float = 5.0, published: str = "published_at", close: str = "period_close_ts", min_weight: float | None = None) -> DataFrame:
    """Weighted means of values per group with weight exp(-age/tau), and n_articles; 0 where all weights vanish.

    min_weight drops rows at or below it from mean and count alike; groups
    without rows left are not there.
    """
    weighted = scored.withColumn("__w", F.exp(-age_days(published, close) / F.lit(tau)))
    if min_weight is not None:
        weighted = weighted.where(F.col("__w") > min_weight)
    means = [F.coalesce(F.try_divide(F.sum(F.col("__w") * F.col(v)), F.sum("__w")), F.lit(0.0)).alias(v) for v in values]
    return weighted.groupBy(*by).agg(*means, F.count(F.lit(1)).alias("n_articles"))


def per_period(scored: DataFrame, values: list[str], tau: float = 5.0, key: str = "ticker") -> DataFrame:
    """Per key and period; null keys and articles after their close are errors, see guards.pit_violations."""
    return decayed(scored, values, [key, "period_close_ts"], tau)


def market_wide(scored: DataFrame, values: list[str], tau: float = 5.0) -> DataFrame:
    return decayed(scored, values, ["period_close_ts"], tau, min_weight=MIN_WEIGHT)


def join_unique(left: DataFrame, right: DataFrame, on: list[str], fill: dict[str, float] | None = None, flag: str | None = None) -> DataFrame:
    """Left join whose right side has each key once (checked), so rows neither vanish nor multiply."""
    if not right.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError(f"right side repeats keys {on}")
    marked = right.withColumn("__there", F.lit(True))
    out = left.join(marked, on, "left")
    if flag:
        out = out.withColumn(flag, F.col("__there").isNotNull())
    out = out.drop("__there")
    return out.fillna(fill) if fill else out
