"""Window features over events as a panel: ticker = user_id, close = value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..config import FeatureSpec, LagSpec
from ..functions import windows as fw
from ..functions.windows import add_technical_features, apply_lags
from .base import r, sql_r, table

_ID = ("user_id", "ts")
_PANEL = "SELECT user_id, ts, event_id, value AS close, value * 1.01e0 + (event_id % 7) AS high, value * 0.98e0 AS low, CAST(event_id % 97 + 1 AS DOUBLE) AS volume FROM events"


def panel(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.col("value").alias("close"), (F.col("value") * 1.01 + F.col("event_id") % 7).alias("high"), (F.col("value") * 0.98).alias("low"), (F.col("event_id") % 97 + 1).cast("double").alias("volume"))


def _w():
    return fw.panel("user_id", "ts")


def _sql(columns: str, extra: str = "") -> str:
    return f"WITH e AS ({_PANEL}){extra} SELECT user_id, ts, {columns} FROM {'x' if extra else 'e'} WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _full(x: str, n: int, e: str) -> str:
    return sql_r(f"CASE WHEN count({x}) {_frame(n)} = {n} THEN {e} END", 6)


def _named(df, names):
    return df.select(*_ID, *[r(n, 6).alias(n) for n in names])


@register("ret_log", _sql(", ".join(f"{sql_r(f'ln(lag(close, 1) OVER w / lag(close, {n + 1}) OVER w)', 6)} AS ret_{n}d_log" for n in (1, 5, 10, 21))))
def ret_log(spark, sf_dir):
    """As in its SQL, zero prices give infinite logs, which the features of models have as nulls."""
    past = lambda n: F.lag("close", n).over(_w())
    df = fw.with_log_ratios(panel(spark, sf_dir), _ID, {f"ret_{n}d_log": (past(1), past(n + 1)) for n in (1, 5, 10, 21)})
    return _named(df, [f"ret_{n}d_log" for n in (1, 5, 10, 21)])


@register("sma", _sql(", ".join(f"{_full('close', n, f'avg(close) {_frame(n)}')} AS sma_{n}" for n in (5, 10, 21, 63))))
def sma(spark, sf_dir):
    return _named(panel(spark, sf_dir).select(*_ID, *fw.sma("close", _w(), (5, 10, 21, 63))), [f"sma_{n}" for n in (5, 10, 21, 63)])


_LR = ", x AS (SELECT *, ln(close / lag(close, 1) OVER (PARTITION BY user_id ORDER BY ts)) AS lr FROM e)"


@register("volatility", _sql(", ".join(f"{_full('lr', n, f'stddev_samp(lr) {_frame(n)}')} AS volatility_{n}" for n in (21, 63)), _LR))
def volatility(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("lr", fw.log_return(F.col("close"), _w()))
    return _named(df.select(*_ID, *fw.volatility("lr", _w(), (21, 63))), ["volatility_21", "volatility_63"])


@register("volume_zscore", _sql(f"{_full('volume', 21, f'(lag(volume, 1) OVER w - avg(volume) {_frame(21)}) / nullif(stddev_samp(volume) {_frame(21)}, 0)')} AS volume_zscore_21"))
def volume_zscore(spark, sf_dir):
    return _named(panel(spark, sf_dir).select(*_ID, fw.volume_zscore("volume", _w(), 21)), ["volume_zscore_21"])


_MID, _SD = f"avg(close) {_frame(20)}", f"stddev_samp(close) {_frame(20)}"


@register("bollinger", _sql(f"{_full('close', 20, _MID)} AS bb_mid, {_full('close', 20, f'{_MID} + 2 * {_SD}')} AS bb_upper, {_full('close', 20, f'{_MID} - 2 * {_SD}')} AS bb_lower"))
def bollinger(spark, sf_dir):
    return _named(panel(spark, sf_dir).select(*_ID, *fw.bollinger("close", _w(), 20, 2.0)), ["bb_mid", "bb_upper", "bb_lower"])


_N = (1, 3, 5, 10, 21)


def _lag_query(name: str, method: str, sql: str):
    @register(name, sql)
    def query(spark, sf_dir):
        df = apply_lags(panel(spark, sf_dir).select(*_ID, "close", "volume"), ["close", "volume"], LagSpec(_N, (method,)), "user_id", "ts")
        return _named(df, [f"{c}_{method}{n}" for c in ("close", "volume") for n in _N])

    return query


_lag_query("lag_features", "lag", _sql(", ".join(f"{sql_r(f'lag({c}, {n}) OVER w', 6)} AS {c}_lag{n}" for c in ("close", "volume") for n in _N)))
_lag_query("rollmean", "rollmean", _sql(", ".join(f"{_full(c, n, f'avg({c}) {_frame(n)}')} AS {c}_rollmean{n}" for c in ("close", "volume") for n in _N)))
_lag_query("rollstd", "rollstd", _sql(", ".join(f"{_full(c, n, f'stddev_samp({c}) {_frame(n)}')} AS {c}_rollstd{n}" for c in ("close", "volume") for n in _N)))


@register("fwd_targets", _sql(", ".join(f"{sql_r(f'ln(lead(close, {n}) OVER w / close)', 6)} AS ret_h{n}" for n in (1, 5, 10, 21, 63))))
def fwd_targets(spark, sf_dir):
    """As in its SQL, zero prices give infinite logs, which the labels of models have as nulls."""
    df = fw.with_log_ratios(panel(spark, sf_dir), _ID, {f"ret_h{n}": (F.lead("close", n).over(_w()), F.col("close")) for n in (1, 5, 10, 21, 63)})
    return _named(df, [f"ret_h{n}" for n in (1, 5, 10, 21, 63)])


# ---------------------------------------------------------------- recursive smoothing


def _ewm(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: {1 - alpha!r}::DOUBLE * a + {alpha!r}::DOUBLE * b)"


def _past(columns: dict[str, str], inner: str) -> str:
    lagged = ", ".join(f"{sql_r(f'lag({e}, 1) OVER w', 6)} AS {n}" for n, e in columns.items())
    return f"WITH e AS ({_PANEL}), {inner} SELECT user_id, ts, {lagged} FROM y WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


def _technical(spark, sf_dir, names):
    return _named(add_technical_features(panel(spark, sf_dir), FeatureSpec(), "user_id", "ts"), names)


@register("ema", _past({f"ema_{n}": f"e{n}" for n in (5, 10, 21, 63)}, f"y AS (SELECT user_id, ts, {', '.join(f'{_ewm("close", 2 / (n + 1))} AS e{n}' for n in (5, 10, 21, 63))} FROM e)"))
def ema(spark, sf_dir):
    return _technical(spark, sf_dir, [f"ema_{n}" for n in (5, 10, 21, 63)])


_RSI = "CASE WHEN g = 0 THEN 0e0 WHEN l = 0 THEN 100e0 ELSE 100 - 100 / (1 + g / l) END"


@register(
    "rsi",
    _past({"rsi_14": "v"}, f"d AS (SELECT *, close - lag(close, 1) OVER (PARTITION BY user_id ORDER BY ts) AS c FROM e), h AS (SELECT *, CASE WHEN c IS NOT NULL THEN greatest(c, 0) END AS up, CASE WHEN c IS NOT NULL THEN greatest(-c, 0) END AS down FROM d), z AS (SELECT user_id, ts, {_ewm('up', 1 / 14)} AS g, {_ewm('down', 1 / 14)} AS l FROM h), y AS (SELECT user_id, ts, CASE WHEN g IS NOT NULL THEN {_RSI} END AS v FROM z)"),
)
def rsi(spark, sf_dir):
    return _technical(spark, sf_dir, ["rsi_14"])


@register(
    "macd",
    _past({"macd": "m", "macd_signal": "s", "macd_hist": "m - s"}, f"a AS (SELECT user_id, ts, {_ewm('close', 2 / 13)} - {_ewm('close', 2 / 27)} AS m FROM e), y AS (SELECT user_id, ts, m, {_ewm('m', 2 / 10)} AS s FROM a)"),
)
def macd(spark, sf_dir):
    return _technical(spark, sf_dir, ["macd", "macd_signal", "macd_hist"])


_ATR = _past({"atr_14": "v"}, f"p AS (SELECT *, lag(close, 1) OVER (PARTITION BY user_id ORDER BY ts) AS pc FROM e), t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p), y AS (SELECT user_id, ts, {_ewm('tr', 1 / 14)} AS v FROM t)")


@register("atr", _ATR)
def atr(spark, sf_dir):
    return _technical(spark, sf_dir, ["atr_14"])
