"""Queries that SQL cannot express: fitted models, searches, scored text, walk-forward runs, streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..catalog import register
from ..config import ContextSpec, WalkForwardSpec
from ..functions.scores import LexiconScorer, score_cached, score_with
from ..functions.windows import add_technical_features
from ..operators import forecast, guards, models
from ..operators.context import ContextEstimator, serving
from ..operators.folds import balanced_fold, hash_place, random_holdout, selection_split
from .base import r, sql_r, table
from .panel import panel
from .sessions import ARTICLE_KEY_SQL, _lexicon_sql


@register("lexicon_sentiment_udf", _lexicon_sql())
def lexicon_sentiment_udf(spark, sf_dir):
    """The batched scorer; the same numbers as lexicon_sentiment gives in SQL expressions."""
    return table(spark, sf_dir, "documents").select("doc_id", score_with(LexiconScorer(), F.col("text")).alias("s")).select("doc_id", *[r(F.col(f"s.{k}"), 6).alias(k) for k in ("pos", "neg", "neu", "score")])


@register("cached_scoring", f"WITH s AS ({_lexicon_sql()}), k AS ({ARTICLE_KEY_SQL}) SELECT doc_id, article_key, score FROM s JOIN k USING (doc_id)")
def cached_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    empty = spark.createDataFrame([], "article_key string, model_name string, model_revision string, pos double, neg double, neu double, score double")
    scored, _ = score_cached(docs, empty, LexiconScorer())
    return scored.select("doc_id", "article_key", r("score", 6).alias("score"))


_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_BASE = ["l_quantity", "l_discount", "l_tax"]
_CONTEXT = ["l_suppkey_l_extendedprice_mean", "l_returnflag_l_extendedprice_mean"]
_NEEDED = ["l_suppkey", "l_returnflag", *_BASE, "l_extendedprice", "place"]


@contextmanager
def _kept(df):
    """df stored while it is in use, as every level and pass reads it."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _sides(spark, sf_dir, keys=()):
    """Training rows with their place in the hash order of folds and splits, and test rows; spoiling changes no key, so the place serves all legs."""
    li = table(spark, sf_dir, "lineitem").select(*_KEY, "l_returnflag", *_BASE, "l_extendedprice")
    split = random_holdout(li, _KEY)
    train, test = (split.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return hash_place(train, _KEY).select(*keys, *_NEEDED), test.select(*_NEEDED[:-1])


def _enriched(train, test, strategy="random", keys=("l_suppkey", "l_returnflag"), context=_CONTEXT):
    """Both sides with context."""
    spec = ContextSpec("l_extendedprice", keys, ("mean", "std", "count"), min_group_size=3, strategy=strategy, n_folds=3)
    folds = lambda d: balanced_fold(d, _KEY, spec.n_folds, spec.seed, place="place")
    enriched, model = ContextEstimator(serving(spec, context), fold_of=folds).fit_transform(train)
    return enriched, model.transform(test)


def _legs(train, test, strategy="random"):
    return models.two_legs("ridge", *_enriched(train, test, strategy), _BASE, _CONTEXT, "l_extendedprice")


@register("ridge_fit")
def ridge_fit(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    with _kept(train):
        leg = _legs(train, test)
    rows = [("baseline", leg.base.rmse, leg.base.mae, leg.base.r2), ("context", leg.context.rmse, leg.context.mae, leg.context.r2)]
    return spark.createDataFrame(rows, "leg string, rmse double, mae double, r2 double")


_SEARCHED = [f"{level}_l_extendedprice_{s}" for level in ("l_suppkey", "l_returnflag", "l_suppkey__l_returnflag") for s in ("mean", "std", "count")]


@register("feature_search")
def feature_search(spark, sf_dir):
    """The whole search over all statistics of both keys and of their pair: random sets, ablations and significant sets."""
    train, test = _sides(spark, sf_dir)
    with _kept(train):
        enriched, test = _enriched(selection_split(train, _KEY, 0.2, tail=False, place="place"), test, context=_SEARCHED)
        found = models.FeatureSearch(_BASE, _SEARCHED, "l_extendedprice").run_split(enriched, test, ablation=True, significance=True)
    return spark.createDataFrame([(x.strategy, len(x.features), x.validation_rmse, x.strategy == found.best.strategy) for x in found.results], "strategy string, n_features int, validation_rmse double, best boolean")


def _advantage(train, test, column, seed, values=None):
    """What context gains after a column of the training rows was permuted."""
    with _kept(guards.permuted(train, column, _KEY, seed, values).select(*_NEEDED)) as spoiled:
        return _legs(spoiled, test).improvement


@register("permuted_target")
def permuted_target(spark, sf_dir):
    train, test = _sides(spark, sf_dir, [c for c in _KEY if c not in _NEEDED])
    with _kept(train), _kept(guards.values_in_order(train, "l_extendedprice", _KEY)) as values:
        found = [_advantage(train, test, "l_extendedprice", s, values) for s in (1, 2)]
    return spark.createDataFrame([(k, v, guards.permuted_target_passes(found)) for k, v in enumerate(found)], "run int, advantage double, passed boolean")


@register("crossfit_ab")
def crossfit_ab(spark, sf_dir):
    """What in-fold statistics would seem to gain on the training side of the same experiment: the leakage they carry."""
    found = {}
    train, test = _sides(spark, sf_dir)
    with _kept(train):
        for strategy in ("random", "off"):
            found[strategy] = _legs(train, test, strategy).improvement
    signal = guards.leakage_signal(found["random"], found["off"])
    return spark.createDataFrame([(found["random"], found["off"], signal)], "out_of_fold double, in_fold double, leakage_signal_pp double")


@register("shuffled_groups")
def shuffled_groups(spark, sf_dir):
    """Real and shuffled groups are keys side by side, so one set of statistics and one pass over each side serve both legs."""
    train, test = _sides(spark, sf_dir, [c for c in _KEY if c not in _NEEDED])
    flag = F.col("l_returnflag").alias("shuffled")
    with _kept(train), _kept(guards.permuted(train.select("*", flag), "shuffled", _KEY, 5).select(*_NEEDED, "shuffled")) as both:
        sets = [_CONTEXT, [_CONTEXT[0], "shuffled_l_extendedprice_mean"]]
        sides = _enriched(both, test.select("*", flag), keys=("l_suppkey", "l_returnflag", "shuffled"), context=[*_CONTEXT, *sets[1]])
        real, shuffled = (x.improvement for x in models.legs("ridge", *sides, _BASE, sets, "l_extendedprice"))
    return spark.createDataFrame([(real, shuffled, guards.shuffled_groups_passes(real, shuffled))], "real double, shuffled double, passed boolean")


@register("gbt_walk_forward")
def gbt_walk_forward(spark, sf_dir):
    """A short walk-forward over daily closes of events: one horizon, small trees."""
    e = panel(spark, sf_dir)
    daily = e.groupBy(F.col("user_id").alias("ticker"), F.date_trunc("day", "ts").alias("period_close_ts")).agg(F.avg("close").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    features = add_technical_features(daily).select("ticker", "period_close_ts", "close", "ret_1d_log", "sma_5", "ema_5", "macd").withColumn("sector", F.col("ticker") % 5)
    spec = WalkForwardSpec(horizons=(1,), train=20, val=3, test=3, step=3, trees=3, depth=2, oof_folds=2)
    return forecast.run_walk_forward(features, spec).predictions.select("fold_idx", "split", "ticker", "period_close_ts", "ret_h1", "pred_h1", "pred_h1_q05", "pred_h1_q95")


_WEIGHT = "exp(-(epoch_us(w + INTERVAL 1 HOUR) - epoch_us(ts)) / 86400e6 / 5)"


@register("stream_decayed_windows", f"SELECT event_type, w AS window_start, {sql_r(f'sum({_WEIGHT} * value) / sum({_WEIGHT})', 6)} AS value, count(*) AS n_events FROM (SELECT *, date_trunc('hour', ts) AS w FROM events) GROUP BY event_type, w")
def stream_decayed_windows(spark, sf_dir):
    from ..streaming.windows import decayed_windows_once

    windows = decayed_windows_once(spark, f"{sf_dir}/events.parquet")
    return windows.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), r("value", 6).alias("value"), "n_events")


_PRIORITY = "OVER (PARTITION BY o_orderpriority)"


@register("stream_context", f"SELECT o_orderkey, {sql_r(f'avg(o_totalprice) {_PRIORITY}')} AS o_orderpriority_o_totalprice_mean, count(o_totalprice) {_PRIORITY} AS o_orderpriority_o_totalprice_count FROM orders")
def stream_context(spark, sf_dir):
    from ..streaming.context import enrich_once

    out = enrich_once(spark, f"{sf_dir}/orders.parquet")
    return out.withColumn("o_orderpriority_o_totalprice_mean", r("o_orderpriority_o_totalprice_mean"))


@register("panel_enrichment")
def panel_enrichment(spark, sf_dir):
    """Rolling context of daily closes over tickers, segments and months; nations and regions stand for industry and size."""
    from ..config import HierarchySpec
    from ..operators.enrich import PanelEnricher

    daily = panel(spark, sf_dir).groupBy(F.col("user_id").alias("ticker"), F.date_trunc("day", "ts").alias("period_close_ts")).agg(F.avg("close").alias("close"))
    from ..functions.windows import panel as window
    from ..functions.windows import returns

    features = daily.select("*", *returns("close", window(), (1,)))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").cast("string").alias("industry"), (F.col("c_nationkey") % 3).cast("string").alias("mktcap_bucket"))
    out, _ = PanelEnricher(c, HierarchySpec(min_group_size=5, n_folds=3)).fit_transform(features)
    return out.select("ticker", "period_close_ts", "sector", "ticker_ret_1d_mean", "sector_ret_1d_mean", "sector__time_bucket_ret_1d_mean", "global_ret_1d_mean")
