"""Leakage guards on clean and on spoiled data: clean data has no violations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import windows as fw
from ..operators import asof, guards
from ..operators.prepare import alive, requested
from .base import r, sql_r, table
from .panel import _frame, _PANEL, panel
from .sessions import _ARTICLES, _BOUND, _S, articles, bound, sessions

_J = f"WITH {_S}, {_ARTICLES}, {_BOUND}"
#: every 50th article is moved a week past its close
_LATE = "SELECT *, CASE WHEN event_id % 50 = 0 THEN published_at + INTERVAL 7 DAY ELSE published_at END AS p FROM j"


def _late(spark, sf_dir):
    moved = F.when(F.col("event_id") % 50 == 0, F.col("published_at") + F.expr("INTERVAL 7 DAYS")).otherwise(F.col("published_at"))
    return bound(spark, sf_dir).withColumn("published_at", moved.cast("timestamp_ntz"))


@register("guard_pit", f"{_J} SELECT event_id FROM j WHERE published_at > period_close_ts")
def guard_pit(spark, sf_dir):
    return guards.pit_violations(bound(spark, sf_dir)).select("event_id")


@register("guard_pit_mutated", f"{_J} SELECT event_id FROM ({_LATE}) WHERE p > period_close_ts")
def guard_pit_mutated(spark, sf_dir):
    return guards.pit_violations(_late(spark, sf_dir)).select("event_id")


@register("guard_tight", f"{_J}, m AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN published_at - INTERVAL 5 DAY ELSE published_at END AS p, period_close_ts FROM j) SELECT event_id FROM m JOIN s USING (period_close_ts) WHERE p <= previous_close")
def guard_tight(spark, sf_dir):
    moved = F.when(F.col("event_id") % 10 == 0, F.col("published_at") - F.expr("INTERVAL 5 DAYS")).otherwise(F.col("published_at"))
    early = bound(spark, sf_dir).withColumn("published_at", moved.cast("timestamp_ntz"))
    return guards.tightness_violations(early, sessions(spark, sf_dir)).select("event_id")


@register("guard_fk", f"{_J} SELECT event_id FROM j WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.period_close_ts = j.period_close_ts AND dayofweek(s.period_close_ts) <> 1)")
def guard_fk(spark, sf_dir):
    held = sessions(spark, sf_dir).where("dayofweek(period_close_ts) <> 2")
    return guards.fk_violations(bound(spark, sf_dir), held, ["period_close_ts"]).select("event_id")


@register("guard_prob_sum", "SELECT event_id FROM events WHERE event_id % 100 = 3")
def guard_prob_sum(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("neu", F.when(F.col("event_id") % 100 == 3, F.lit(0.01)).otherwise(F.col("neu")))
    return guards.prob_sum_violations(a).select("event_id")


@register("guard_cache_fresh", "SELECT doc_id FROM documents WHERE lang = 'en' AND text NOT IN (SELECT text FROM documents WHERE lang <> 'en')")
def guard_cache_fresh(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("article_key"))
    return guards.stale_cache_violations(docs.where("lang <> 'en'"), docs.where("lang = 'en'")).select("doc_id")


@register("guard_reproducible", f"{_J}, g AS (SELECT DISTINCT ticker, period_close_ts FROM j) SELECT ticker, period_close_ts, CASE WHEN ticker % 9 = 2 THEN 'missing' ELSE 'differs' END AS problem FROM g WHERE ticker % 9 IN (2, 5)")
def guard_reproducible(spark, sf_dir):
    """Stored aggregates of some tickers are missing, of others shifted."""
    j = bound(spark, sf_dir)
    stored = asof.per_period(j, ["score"]).where("ticker % 9 <> 2").withColumn("score", F.when(F.col("ticker") % 9 == 5, F.col("score") + 0.001).otherwise(F.col("score")))
    return guards.reproducible_violations(j, stored, ["score"], ["ticker", "period_close_ts"])


_SMA = f"CASE WHEN count(close) {_frame(5)} = 5 THEN avg(close) {_frame(5)} END"
_PEEK = "CASE WHEN count(close) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN avg(close) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END"


def _honest(spark, sf_dir):
    return panel(spark, sf_dir).select("user_id", "ts", "close", *fw.sma("close", fw.panel("user_id", "ts"), (5,)))


@register("guard_lookahead", f"WITH e AS ({_PANEL}) SELECT user_id, ts, 'sma_5' AS indicator FROM e WHERE false")
def guard_lookahead(spark, sf_dir):
    h = _honest(spark, sf_dir)
    return guards.lookahead_violations(h, h, ["user_id", "ts"], ["sma_5"]).select("user_id", "ts", "indicator")


@register("guard_lookahead_mutated", f"WITH e AS ({_PANEL}), x AS (SELECT user_id, ts, {_SMA} AS a, {_PEEK} AS b FROM e) SELECT user_id, ts, 'sma_5' AS indicator FROM x WHERE NOT (a IS NOT DISTINCT FROM b OR coalesce(abs(a - b) <= 1e-9, false))")
def guard_lookahead_mutated(spark, sf_dir):
    h = _honest(spark, sf_dir)
    w = fw.panel("user_id", "ts").rowsBetween(-4, 0)
    peeking = h.withColumn("sma_5", F.when(F.count("close").over(w) == 5, F.avg("close").over(w)))
    return guards.lookahead_violations(peeking, h, ["user_id", "ts"], ["sma_5"]).select("user_id", "ts", "indicator")


_INDICATORS = [*[f"ret_{n}d_log" for n in (1, 5, 10, 21)], *[f"{k}_{n}" for k in ("sma", "ema") for n in (5, 10, 21, 63)], "rsi_14", "macd", "macd_signal", "macd_hist", "volatility_21", "volatility_63", "volume_zscore_21", "atr_14", "bb_mid", "bb_upper", "bb_lower"]


@register(
    "guard_lookahead_all",
    f"""WITH e AS ({_PANEL}), c AS (SELECT *, max(CASE WHEN event_id % 5 = 2 THEN ts END) OVER (PARTITION BY user_id) AS cut, count(*) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT unnest({_INDICATORS!r}) AS indicator, 0::BIGINT AS n_violations UNION ALL SELECT 'peek_5', count(*) FROM c WHERE ts = cut AND k >= 5""",
)
def guard_lookahead_all(spark, sf_dir):
    """All technical indicators, and one that sees its own row, against prices changed from a time of each ticker on."""
    last = F.max(F.when(F.col("event_id") % 5 == 2, F.col("ts"))).over(Window.partitionBy("user_id"))
    own = fw.panel("user_id", "ts").rowsBetween(-4, 0)

    def build(prices):
        peeking = prices.withColumn("peek_5", F.when(F.count("close").over(own) == 5, F.avg("close").over(own)))
        return fw.add_technical_features(peeking, key="user_id", ts="ts")

    names = [*_INDICATORS, "peek_5"]
    found = guards.spoiled_violations(panel(spark, sf_dir).withColumn("cut", last), build, ["user_id", "ts"], "ts", "cut", names, ["close", "high", "low", "volume"])
    counts = found.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(n,) for n in names], "indicator string").join(counts, "indicator", "left").select("indicator", F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"))


@register("guard_target_isolation", f"SELECT column_name AS name FROM (DESCRIBE SELECT close, volume, high AS ret_5d_log, close AS ret_h1, close AS ret_h5, low AS ret_h5_lag3, low AS resid_h1, low AS threshold_h1 FROM ({_PANEL})) WHERE regexp_matches(column_name, '(^|_)(ret|resid)_h[0-9]')")
def guard_target_isolation(spark, sf_dir):
    """Targets among the columns of a feature table."""
    p = panel(spark, sf_dir).select("user_id", "ts", "close", "volume", F.col("high").alias("ret_5d_log"), "low")
    lagged = p.select("close", "volume", "ret_5d_log", *fw.forward_targets("close", fw.panel("user_id", "ts"), (1, 5)), F.col("low").alias("ret_h5_lag3"), F.col("low").alias("resid_h1"), F.col("low").alias("threshold_h1"))
    return spark.createDataFrame([(n,) for n in guards.target_columns(lagged.columns)], "name string")


@register("guard_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def guard_repeated_keys(spark, sf_dir):
    return guards.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LISTED = "SELECT o_custkey AS ticker, min(o_orderdate) AS listed_at, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-06-01' THEN max(o_orderdate) END AS delisted_at FROM orders GROUP BY o_custkey"


def _universe(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = F.max("o_orderdate")
    return o.groupBy(F.col("o_custkey").alias("ticker")).agg(F.min("o_orderdate").alias("listed_at"), F.when(last < F.lit("2001-06-01").cast("timestamp_ntz"), last).alias("delisted_at"))


@register("alive_universe", f"SELECT ticker FROM ({_LISTED}) WHERE (listed_at IS NULL OR listed_at <= TIMESTAMP '1996-01-01') AND (delisted_at IS NULL OR delisted_at >= TIMESTAMP '1995-06-01')")
def alive_universe(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return _universe(spark, sf_dir).where(alive(at("1995-06-01"), at("1996-01-01"))).select("ticker")


@register(
    "requested_tickers",
    f"""WITH u AS (SELECT 'C' || ticker AS ticker, listed_at, delisted_at FROM ({_LISTED})), q AS (SELECT 'C' || c_custkey AS ticker FROM customer UNION ALL SELECT unnest(['c1', 'C-1', 'BRK.B', 'a b']))
    SELECT ticker, CASE WHEN NOT regexp_matches(ticker, '^[A-Z0-9.-]+$') THEN 'bad syntax' WHEN u.ticker IS NULL THEN 'unknown' WHEN listed_at > TIMESTAMP '1995-06-01' THEN 'not listed yet' WHEN delisted_at < TIMESTAMP '1995-03-01' THEN 'delisted before' END AS reason FROM q LEFT JOIN u USING (ticker)""".replace("u.ticker IS NULL", "u.listed_at IS NULL"),
)
def requested_tickers(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    universe = _universe(spark, sf_dir).withColumn("ticker", F.concat(F.lit("C"), F.col("ticker")))
    ask = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("ticker")).union(spark.createDataFrame([("c1",), ("C-1",), ("BRK.B",), ("a b",)], "ticker string"))
    return requested(ask, universe, at("1995-03-01"), at("1995-06-01"))


@register("survivorship", f"SELECT count(delisted_at) AS n_delisted, count(delisted_at) >= 13 AS passed FROM ({_LISTED})")
def survivorship(spark, sf_dir):
    u = _universe(spark, sf_dir).withColumn("delisted_at", F.coalesce(F.date_format("delisted_at", "yyyy-MM-dd"), F.lit("still listed")))
    return guards.survivors(u)


@register("permuted_column", "SELECT count(*) AS n, " + sql_r('sum(o_totalprice)', 2) + " AS total, true AS moved FROM orders")
def permuted_column(spark, sf_dir):
    """A permutation keeps the values and moves most of them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    p = guards.permuted(o, "o_totalprice", ["o_orderkey"], 3)
    both = p.join(o.withColumnRenamed("o_totalprice", "was"), "o_orderkey")
    return both.agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), (F.avg((F.col("was") != F.col("o_totalprice")).cast("double")) > 0.9).alias("moved"))

