"""Events as articles bound to daily sessions, decayed aggregates, text scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions.scores import NEGATIVE, POSITIVE, article_key, lexicon_score
from ..operators import asof
from ..operators.guards import monotone_violations
from ..operators.prepare import first_of
from .base import r, sql_r, table

#: Weekday closes at 16:00, the calendar that articles bind to.
_SESSIONS = "SELECT DISTINCT date_trunc('day', ts) + INTERVAL 16 HOUR AS period_close_ts FROM events WHERE dayofweek(ts) NOT IN (0, 6) AND ts < TIMESTAMP '2024-01-29' AND ts >= TIMESTAMP '2024-01-03'"
_S = f"s AS (SELECT period_close_ts, lag(period_close_ts) OVER (ORDER BY period_close_ts) AS previous_close FROM ({_SESSIONS}))"
_SCORE = "(value % 10) / 5e0 - 1"


def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("dayofweek(ts) NOT IN (1, 7) AND ts < timestamp_ntz '2024-01-29' AND ts >= timestamp_ntz '2024-01-03'")
    return asof.sessions_of(e.select((F.date_trunc("day", "ts") + F.expr("INTERVAL 16 HOURS")).cast("timestamp_ntz").alias("c")), "c")


def articles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    score = (F.col("value") % 10) / 5.0 - 1
    return e.select("event_id", F.col("user_id").alias("ticker"), F.col("ts").alias("published_at"), score.alias("score"), (F.col("value") % 3 / 3).alias("pos"), (1 - F.col("value") % 3 / 3).alias("neg"), F.lit(0.0).alias("neu"))


_ARTICLES = f"a AS (SELECT event_id, user_id AS ticker, ts AS published_at, {_SCORE} AS score, value % 3 / 3 AS pos, 1 - value % 3 / 3 AS neg, 0e0 AS neu FROM events)"
_BOUND = "j AS (SELECT a.*, s.period_close_ts FROM a JOIN s ON (previous_close IS NULL AND published_at = period_close_ts) OR (published_at > previous_close AND published_at <= period_close_ts))"
_EARLY = "j AS (SELECT a.*, s.period_close_ts FROM a ASOF JOIN s ON a.published_at <= s.period_close_ts)"


def bound(spark, sf_dir, early=False):
    return asof.bind_forward(articles(spark, sf_dir), sessions(spark, sf_dir), early_to_first=early)


@register("asof_forward", f"WITH {_S}, {_ARTICLES}, {_BOUND} SELECT event_id, ticker, published_at, period_close_ts FROM j")
def asof_forward(spark, sf_dir):
    return bound(spark, sf_dir).select("event_id", "ticker", "published_at", "period_close_ts")


@register("asof_market_wide", f"WITH {_S}, {_ARTICLES}, {_EARLY} SELECT event_id, published_at, period_close_ts FROM j")
def asof_market_wide(spark, sf_dir):
    return bound(spark, sf_dir, True).select("event_id", "published_at", "period_close_ts")


@register(
    "asof_dropped",
    f"WITH {_S}, {_ARTICLES} SELECT event_id, CASE WHEN published_at > hi THEN 'after last session' ELSE 'before first session' END AS reason FROM a, (SELECT min(period_close_ts) AS lo, max(period_close_ts) AS hi FROM s) WHERE published_at > hi OR published_at < lo",
)
def asof_dropped(spark, sf_dir):
    return asof.dropped_articles(articles(spark, sf_dir), sessions(spark, sf_dir)).select("event_id", "reason")


_W = "exp(-((epoch_us(period_close_ts) - epoch_us(published_at)) / 86400e6) / 5)"
_VALUES = ("score", "pos", "neg", "neu")
_MEANS = ", ".join(f"{sql_r(f'sum({_W} * {v}) / sum({_W})', 6)} AS {v}" for v in _VALUES)


def _rounded(df, by):
    return df.select(*by, *[r(v, 6).alias(v) for v in _VALUES], "n_articles")


@register("decay_per_period", f"WITH {_S}, {_ARTICLES}, {_BOUND} SELECT ticker, period_close_ts, {_MEANS}, count(*) AS n_articles FROM j GROUP BY ALL")
def decay_per_period(spark, sf_dir):
    return _rounded(asof.per_period(bound(spark, sf_dir), list(_VALUES)), ["ticker", "period_close_ts"])


@register("decay_market_wide", f"WITH {_S}, {_ARTICLES}, {_EARLY} SELECT period_close_ts, {_MEANS}, count(*) AS n_articles FROM j WHERE {_W} > 1e-6 GROUP BY ALL")
def decay_market_wide(spark, sf_dir):
    return _rounded(asof.market_wide(bound(spark, sf_dir, True), list(_VALUES)), ["period_close_ts"])


@register(
    "build_features_join",
    f"""WITH {_S}, {_ARTICLES}, {_BOUND}, d AS (SELECT ticker, period_close_ts, {_MEANS}, count(*) AS n_articles FROM j GROUP BY ALL), k AS (SELECT DISTINCT user_id AS ticker FROM events)
    SELECT k.ticker, s.period_close_ts, coalesce(score, 0e0) AS score, coalesce(n_articles, 0) AS n_articles, score IS NOT NULL AS has_sentiment FROM k CROSS JOIN s LEFT JOIN d USING (ticker, period_close_ts)""",
)
def build_features_join(spark, sf_dir):
    daily = _rounded(asof.per_period(bound(spark, sf_dir), list(_VALUES)), ["ticker", "period_close_ts"]).select("ticker", "period_close_ts", "score", "n_articles")
    tickers = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker")).distinct()
    days = sessions(spark, sf_dir).agg(F.collect_list("period_close_ts").alias("d"))  # one row: the calendar
    grid = tickers.join(F.broadcast(days)).select("ticker", F.explode("d").alias("period_close_ts"))
    return asof.join_unique(grid, daily, ["ticker", "period_close_ts"], {"score": 0.0, "n_articles": 0}, "has_sentiment")


@register("sector_join", "SELECT event_id, user_id, c_mktsegment AS sector FROM events LEFT JOIN (SELECT c_custkey, min_by(c_mktsegment, c_name) AS c_mktsegment FROM customer GROUP BY c_custkey) ON user_id = c_custkey")
def sector_join(spark, sf_dir):
    sectors = first_of(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), ["c_custkey"], ["c_name"])
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(sectors, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", F.col("c_mktsegment").alias("sector"))


def _lexicon_sql() -> str:
    count = lambda words: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(k) for k in words)})))::DOUBLE"
    return f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), c AS (SELECT doc_id, {count(POSITIVE)} AS p, {count(NEGATIVE)} AS n FROM t) SELECT doc_id, {sql_r('p / (p + n + 1)', 6)} AS pos, {sql_r('n / (p + n + 1)', 6)} AS neg, {sql_r('1 / (p + n + 1)', 6)} AS neu, {sql_r('(p - n) / (p + n + 1)', 6)} AS score FROM c"


@register("lexicon_sentiment", _lexicon_sql())
def lexicon_sentiment(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", lexicon_score(F.col("text")).alias("s"))
    return scored.select("doc_id", *[r(F.col(f"s.{k}"), 6).alias(k) for k in ("pos", "neg", "neu", "score")])


ARTICLE_KEY_SQL = "SELECT doc_id, sha256(unhex(printf('%016x', octet_length(encode(text)))) || encode(text) || unhex('0000000000000007') || encode('lexicon') || unhex('0000000000000001') || encode('1')) AS article_key FROM documents"


@register("article_key_sha", ARTICLE_KEY_SQL)
def article_key_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", article_key(F.col("text"), F.lit("lexicon"), F.lit("1")).alias("article_key"))


@register("cache_misses", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", article_key(F.col("text"), F.lit("lexicon"), F.lit("1")).alias("article_key"))
    return docs.join(docs.where("lang = 'en'").select("article_key").distinct(), "article_key", "left_anti").select("doc_id")


@register("guard_weight_monotone", f"WITH {_S}, {_ARTICLES}, {_BOUND}, w AS (SELECT event_id, ticker, period_close_ts, published_at, {_W} AS weight FROM j), l AS (SELECT *, lag(weight) OVER (PARTITION BY ticker, period_close_ts ORDER BY published_at) AS p FROM w) SELECT event_id FROM l WHERE weight < p - 1e-12")
def guard_weight_monotone(spark, sf_dir):
    w = bound(spark, sf_dir).withColumn("weight", F.exp(-asof.age_days("published_at", "period_close_ts") / 5))
    return monotone_violations(w, ["ticker", "period_close_ts"], "published_at").select("event_id")
