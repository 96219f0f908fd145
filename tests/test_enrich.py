import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import ctxloom
from ctxloom.config import FeatureSpec, HierarchySpec, LagSpec, WalkForwardSpec
from ctxloom.operators import datasets
from ctxloom.operators.enrich import PanelEnricher, build_features
from ctxloom.operators.forecast import fit_heads, predict_heads, run_baseline_vs_context

from .test_panel import T0, prices


def sectors(spark):
    return spark.createDataFrame([("A", "tech", "chips", "large"), ("A", "zinc", "x", "small")], "ticker string, sector string, industry string, mktcap_bucket string")


def test_public_names():
    assert all(getattr(ctxloom, n) is not None for n in ctxloom.__all__)


def test_build_features_with_sentiment(spark):
    p = prices(spark, 30)
    s = p.where("ticker = 'A'").select("ticker", "period_close_ts", F.lit(0.5).alias("sentiment_score"), F.lit(2).cast("long").alias("n_articles"))
    out = build_features(p, s, FeatureSpec(returns=(1,), sma=(5,), ema=(5,), volatility=(5,), volume_z=5), LagSpec((1,), ("lag",)))
    assert out.count() == 60 and {"has_sentiment", "sentiment_score_lag1", "sma_5_lag1"} <= set(out.columns)
    assert out.where("ticker = 'B' AND (has_sentiment OR sentiment_score <> 0)").isEmpty()
    with pytest.raises(ValueError):
        build_features(p, s.union(s))


def test_enricher_and_partial_refit(spark):
    p = prices(spark, 60).withColumn("ret_1d_log", F.col("close") / 100).withColumn("ret_h5", F.lit(9.0))
    enricher = PanelEnricher(sectors(spark), HierarchySpec(min_group_size=2, n_folds=3))
    with pytest.raises(RuntimeError):
        enricher.transform_partial(p, T0)
    out, _ = enricher.fit_transform(p)
    assert out.count() == 120 and not [c for c in out.columns if c.startswith("ret_h") or c == "ret_1d_log"]
    assert out.where("ticker = 'B'").select("sector").distinct().first().sector == "unknown" and out.where("ticker = 'A'").select("sector").distinct().first().sector == "tech"
    assert "sector__time_bucket_ret_1d_mean" in out.columns and "ticker__sector_ret_1d_mean" not in out.columns
    boundary = T0 + dt.timedelta(days=40)
    later = enricher.transform_partial(p.where(F.col("period_close_ts") > F.lit(boundary)), boundary)
    want = p.where((F.col("ticker") == "A") & (F.col("period_close_ts") <= F.lit(boundary))).agg(F.avg("ret_1d_log")).first()[0]
    assert later.where("ticker = 'A'").first().ticker_ret_1d_mean == pytest.approx(want)
    with pytest.raises(ValueError):
        enricher.transform_partial(p, boundary)


def test_walk_forward_both_legs(spark):
    p = prices(spark, 40, ("A", "B", "C")).select("ticker", "period_close_ts", "close", (F.col("close") % 7).alias("x"), F.lit("s").alias("sector"))
    spec = WalkForwardSpec(horizons=(1,), train=20, val=5, test=5, step=5, oof_folds=2)
    plain, _, deltas = run_baseline_vs_context(p, spec, lambda sides: {k: d.withColumn("z", F.col("x") * 2) for k, d in sides.items()}, model="ridge")
    assert deltas.count() == plain.folds.count() == 3 and plain.horizon == 1
    assert plain.predictions.where("split = 'test' AND pred_h1 IS NULL").isEmpty() and plain.accuracy.first().n_folds == 3


def test_heads_learn_from_held_out_forecasts(spark):
    """Labels are noise that deep trees can learn by heart: in-sample errors would be near zero, held-out ones are the noise itself."""
    rng = random.Random(4)
    def rows(first, n):
        return spark.createDataFrame([(f"T{i}", T0 + dt.timedelta(days=first + k), "s" + str(i % 2), rng.random(), rng.random(), rng.gauss(0, 1)) for k in range(n) for i in range(12)], "ticker string, period_close_ts timestamp, sector string, a double, b double, ret_h1 double")
    spec = WalkForwardSpec(horizons=(1,), train=40, val=5, test=5, step=5, trees=3, depth=5, rate=0.5, oof_folds=2)
    heads = fit_heads(rows(0, 45), ["a", "b"], spec)
    low, high = heads.spread[1][0.05], heads.spread[1][0.95]
    assert low < -1 and high > 1
    truth = rows(200, 60)
    p = predict_heads(heads, truth, ["a", "b"], spec, ["ticker", "period_close_ts"]).join(truth.select("ticker", "period_close_ts", "ret_h1"), ["ticker", "period_close_ts"])
    inside = p.selectExpr("avg(CAST(ret_h1 BETWEEN pred_h1_q05 AND pred_h1_q95 AS double))").first()[0]
    assert truth.count() == p.count() and 0.8 < inside < 0.98
    with pytest.raises(ValueError):
        fit_heads(rows(0, 3), ["a", "b"], spec)


def test_retail_tables(spark):
    train = spark.createDataFrame([(1, 5, "2015-07-31", 100, 10, 1, 1, "0", "1"), (1, 4, "2015-07-30", 0, 0, 0, 1, "0", "1"), (2, 5, "2015-07-31", 50, 5, 1, 0, "a", "0")], "Store int, DayOfWeek int, Date string, Sales int, Customers int, Open int, Promo int, StateHoliday string, SchoolHoliday string")
    store = spark.createDataFrame([(1, "c", "a", 1270.0, 0), (2, "a", "a", None, 1)], "Store int, StoreType string, Assortment string, CompetitionDistance double, Promo2 int")
    out = {r.Store: r for r in datasets.rossmann(train, store).collect()}
    assert out.keys() == {"1", "2"} and out["2"].CompetitionDistance == 1270.0 and out["1"].week_of_year == 31 and out["1"].DayOfWeek == "5"


def test_demand_panel(spark):
    calendar = spark.createDataFrame([(f"d_{k}", str(dt.date(2024, 1, 1) + dt.timedelta(days=k - 1)), 1 + k // 8, k % 7, 1, 2024, "Fest" if k == 30 else None, None, None, None, k % 2, 0, 0) for k in range(1, 36)], "d string, date string, wm_yr_wk int, wday int, month int, year int, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int")
    sales = spark.createDataFrame([("i1", "D", "C", "S", "CA", *range(1, 36)), ("i2", "D", "C", "S", "CA", *[1] * 35)], "item_id string, dept_id string, cat_id string, store_id string, state_id string, " + ", ".join(f"d_{k} int" for k in range(1, 36)))
    price = spark.createDataFrame([("S", "i1", w, 2.0) for w in range(1, 4)] + [("S", "i2", w, 4.0) for w in range(1, 4)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    out = datasets.m5_panel(calendar, sales, price).orderBy("date").collect()
    assert str(out[0].date) == "2024-01-29" and len(out) == 7 and out[0].demand == 30.0 and out[0].lag_7 == 23.0 and out[0].rolling_mean_7 == 26.0
    assert out[1].event_name_1 == "Fest" and out[0].event_name_1 == "none" and {r.avg_sell_price for r in out} == {3.0} and out[0].snap_state == 1


def test_ranks_and_weighted_positions(spark):
    import random

    import pandas as pd

    from ctxloom.operators.folds import positions
    from ctxloom.operators.linalg import correlation_matrix

    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, 2.0, 5.0]), float(rng.randrange(40)), rng.random() ** 3) for k in range(700)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(5)
    want = pd.DataFrame(rows, columns=["k", "a", "b", "c"])[["a", "b"]]
    want = want.rank().corr().loc["a", "b"]
    assert abs(correlation_matrix(df, ["a", "b"], "spearman")[0, 1] - want) < 1e-9
    got = {r.k: r.at for r in positions(df.select("k", (df.k % 3 + 1).alias("w")), ["k"], "at", "w").collect()}
    total = 0
    for k in range(700):
        assert got[k] == total
        total += k % 3 + 1
