import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ctxloom.config import FeatureSpec, LagSpec
from ctxloom.functions.ewm import with_smoothed
from ctxloom.functions.windows import add_technical_features, apply_lags, forward_targets, panel
from ctxloom.operators import asof, guards, metrics
from ctxloom.operators.linalg import t_two_sided
from ctxloom.operators.selection import SignificanceSelector, lm_statistics

T0 = dt.datetime(2024, 1, 1, 16)


def prices(spark, n=80, tickers=("A", "B")):
    rows = [(t, T0 + dt.timedelta(days=k), c := 100.0 + k + 50 * i + 3 * math.sin(k * (i + 1)), c * 1.01, c * 0.98, 1000.0 + (k * 7) % 13) for i, t in enumerate(tickers) for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, period_close_ts timestamp, close double, high double, low double, volume double")


def test_moving_average_by_hand(spark):
    df = spark.createDataFrame([("A", T0 + dt.timedelta(days=k), 100.0 + k, 1.0, 1.0, 1.0) for k in range(10)], "ticker string, period_close_ts timestamp, close double, high double, low double, volume double")
    got = [r.sma_5 for r in add_technical_features(df).orderBy("period_close_ts").collect()]
    assert got[:5] == [None] * 5 and got[5:7] == [102.0, 103.0] and got[9] == 106.0


def test_features_use_the_past_only(spark):
    """Changing the last row's values changes no feature of that row or before."""
    df = prices(spark)
    last = F.col("period_close_ts") == F.lit(T0 + dt.timedelta(days=79))
    other = df.select("ticker", "period_close_ts", *[F.when(last, F.col(c) * 3).otherwise(F.col(c)).alias(c) for c in ("close", "high", "low", "volume")])
    names = [c for c in add_technical_features(df).columns if c not in df.columns]
    assert len(names) == FeatureSpec().describe()["total"] == 23
    a, b = (add_technical_features(d).select("ticker", "period_close_ts", *names) for d in (df, other))
    assert guards.passed(guards.lookahead_violations(a, b, ["ticker", "period_close_ts"], names))


def ewm_series(values, alpha):
    """The recurrence, one value after another."""
    out, y, weight = [], None, 1.0
    for v in values:
        if y is not None:
            weight *= 1 - alpha
        if v is not None and v == v:
            y = v if y is None else (weight * y + alpha * v) / (weight + alpha)
            weight = 1.0
        out.append(y)
    return out


def test_smoothing_against_the_recurrence(spark):
    """Long series with nulls at the start, alone and in runs, over many blocks, and a sudden change of scale."""
    rng = random.Random(3)
    series = {}
    for t in ("A", "B", "C"):
        values = [None if rng.random() < 0.2 or k < 3 or 500 < k < 900 else 100 + rng.gauss(0, 5) for k in range(3000)]
        values[2000:2010] = [1e9] * 10
        series[t] = values
    series["D"] = [5.0, None, 7.0]
    series["E"] = [None, None]
    rows = [(t, T0 + dt.timedelta(days=k), v) for t, values in series.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, period_close_ts timestamp, x double")
    alphas = {"fast": 0.9, "mid": 2 / 6, "slow": 1 / 14, "slower": 2 / 64, "own": 1.0}
    got = with_smoothed(df, "ticker", "period_close_ts", {n: ("x", a) for n, a in alphas.items()}).orderBy("period_close_ts").collect()
    for t, values in series.items():
        own = [r for r in got if r.ticker == t]
        for n, alpha in alphas.items():
            for r, want in zip(own, ewm_series(values, alpha), strict=True):
                assert r[n] == (want if want is None else pytest.approx(want, rel=1e-9)), (t, n, r.period_close_ts)


def test_smoothing_decays_across_nulls():
    got = ewm_series([None, 1.0, None, 3.0], 0.5)
    assert got[:3] == [None, 1.0, 1.0] and got[3] == pytest.approx(2 + 1 / 3)


def test_flat_series_has_index_zero(spark):
    df = spark.createDataFrame([("A", T0 + dt.timedelta(days=k), 5.0, 5.0, 5.0, 1.0) for k in range(5)], "ticker string, period_close_ts timestamp, close double, high double, low double, volume double")
    assert [r.rsi_14 for r in add_technical_features(df).orderBy("period_close_ts").collect()][2:] == [0.0, 0.0, 0.0]


def test_lags_and_targets(spark):
    df = prices(spark, 8, ("A",))
    out = apply_lags(df, ["close"], LagSpec((1, 3))).orderBy("period_close_ts").collect()
    c = [r.close for r in out]
    assert out[4].close_lag3 == c[1] and out[4].close_rollmean3 == pytest.approx(sum(c[1:4]) / 3) and out[2].close_rollmean3 is None and out[4].close_rollstd1 is None
    y = df.select("period_close_ts", *forward_targets("close", panel(), (2,))).orderBy("period_close_ts").collect()
    assert y[3].ret_h2 == pytest.approx(math.log(c[5] / c[3])) and y[7].ret_h2 is None
    with pytest.raises(ValueError):
        apply_lags(df, ["nope"])


def test_binding_weekends_and_edges(spark):
    closes = [dt.datetime(2024, 7, d, 20) for d in (3, 5, 8)]
    sessions = asof.sessions_of(spark.createDataFrame([(c,) for c in closes], "period_close_ts timestamp"))
    times = [dt.datetime(2024, 7, 3, 19), closes[0], dt.datetime(2024, 7, 3, 20, 0, 1), dt.datetime(2024, 7, 4, 12), closes[1], dt.datetime(2024, 7, 6), dt.datetime(2024, 7, 9)]
    articles = spark.createDataFrame(list(enumerate(times)), "id long, published_at timestamp")
    bound = {r.id: r.period_close_ts for r in asof.bind_forward(articles, sessions).collect()}
    assert bound == {1: closes[0], 2: closes[1], 3: closes[1], 4: closes[1], 5: closes[2]}
    early = {r.id: r.period_close_ts for r in asof.bind_forward(articles, sessions, early_to_first=True).collect()}
    assert early == bound | {0: closes[0]}
    assert {r.id: r.reason for r in asof.dropped_articles(articles, sessions).collect()} == {0: "before first session", 6: "after last session"}


def test_decay_by_hand(spark):
    close = dt.datetime(2024, 7, 8, 20)
    ages = (2 / 24, 8 / 24, 3 + 8 / 24)
    rows = [("AAPL", close, close - dt.timedelta(days=a), s) for a, s in zip(ages, (0.5, 0.2, 0.5))]
    df = spark.createDataFrame(rows, "ticker string, period_close_ts timestamp, published_at timestamp, score double")
    w = [math.exp(-a / 5) for a in ages]
    r = asof.per_period(df, ["score"]).first()
    assert r.score == pytest.approx(sum(x * s for x, s in zip(w, (0.5, 0.2, 0.5))) / sum(w), abs=1e-9) and r.n_articles == 3
    old = df.withColumn("published_at", F.lit(dt.datetime(2023, 1, 1)))
    assert asof.market_wide(old, ["score"]).count() == 0


def test_guards_fire_on_spoiled_data(spark):
    folds = spark.createDataFrame([(0, 5, 6, 7), (1, 9, 8, 10), (2, 9, 8, 11)], "fold_idx int, train_max int, val_min int, val_max int")
    assert {(r.fold_idx, r.problem) for r in guards.fold_violations(folds).collect()} == {(1, "train reaches into validation"), (2, "train reaches into validation"), (1, "folds do not advance")}
    probs = spark.createDataFrame([(0.5, 0.5, 0.0), (0.5, 0.6, 0.0), (float("nan"), 0.5, 0.5)], "pos double, neg double, neu double")
    assert guards.report(guards.prob_sum_violations(probs))["n_violations"] == 2
    assert guards.target_columns(["ret_h5", "ret_5d_log", "x_ret_h5_lag1"], (5,)) == ["ret_h5", "x_ret_h5_lag1"]
    assert guards.promotion({"permuted_target": {"pass": True}})["promoted"] is False
    with pytest.raises(ValueError):
        asof.join_unique(probs, probs.union(probs), ["pos", "neg"])


def test_portfolio_by_hand(spark):
    df = spark.createDataFrame([("d", k, k / 100, k / 100) for k in range(10)] + [("e", k, float(k), 0.1 * k) for k in range(4)] + [("f", 0, 1.0, 1.0)], "ts string, name int, pred double, ret double")
    got = {r.ts: r.long_short for r in metrics.long_short(df, "ts", "pred", "ret", "name").collect()}
    assert got["d"] == pytest.approx(0.09) and got["e"] == pytest.approx(0.3) and got["f"] is None
    flat = spark.createDataFrame([(0.1,), (0.1,), (-0.05,)], "r double")
    assert flat.limit(2).agg(metrics.sharpe(F.col("r"))).first()[0] is None
    assert flat.agg(metrics.sortino(F.col("r"))).first()[0] == pytest.approx(0.05 / 0.05 * math.sqrt(252))
    tied = spark.createDataFrame([(5, 1.0), (1, 1.0), (21, None)], "horizon int, sharpe double")
    assert metrics.select_horizon(tied, "sharpe").first().horizon == 1


def test_bins_match_quantile_cuts():
    """Top and bottom bins of the closed form hold the rows that linear quantile cuts give."""
    import numpy as np

    for n in range(2, 60):
        b = min(10, n)
        own = [max(-(-((r - 1) * b) // (n - 1)) - 1, 0) for r in range(1, n + 1)]
        edges = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, b + 1))
        cut = np.clip(np.searchsorted(edges, np.arange(1, n + 1), "left") - 1, 0, b - 1)
        assert [x == 0 for x in own] == [x == 0 for x in cut.tolist()] and [x == b - 1 for x in own] == [x == b - 1 for x in cut.tolist()]


def test_linear_statistics(spark):
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4) and t_two_sided(0.0, 5) == pytest.approx(1.0)
    df = spark.range(500).selectExpr("double(pmod(id * 37, 101)) AS a", "double(pmod(id * 53, 97)) AS b", "double(pmod(id * 37, 101)) * 2 + double(pmod(id * 71, 13)) AS y")
    s = {x.feature: x for x in lm_statistics(df, ["a", "b"], "y").features}
    assert s["a"].p_value < 1e-6 and s["a"].coefficient == pytest.approx(s["a"].pearson_r, abs=0.05)
    assert SignificanceSelector(["a", "b"], "y", 1e-4, backward=True).fit(df).chosen == ["a"]


def _as_sql(spark, tmp_path, name, values):
    """A query and its SQL over one ticker with these values; not finite ones as text."""
    import duckdb

    from ctxloom.catalog import oracle_sql, queries

    con = duckdb.connect()
    rows = ", ".join(f"({k}, TIMESTAMP '2024-01-01' + INTERVAL {k} HOUR, 1, {'NULL' if v is None else repr(str(v))}::DOUBLE)" for k, v in enumerate(values))
    path = tmp_path / "events.parquet"
    con.execute(f"COPY (SELECT e::BIGINT AS event_id, ts, u::BIGINT AS user_id, value FROM (VALUES {rows}) AS t(e, ts, u, value)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    text = lambda rows: [tuple(x if x is None or math.isfinite(x) else str(x) for x in r) for r in rows]
    own = queries()[name](spark, str(tmp_path))
    names = [c for c in own.columns if c.startswith("ret_")]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()[name]}) ORDER BY ts").fetchall()
    return text(own.orderBy("ts").select(*names).collect()), text(want)


_ODD = [1.0, 0.0, 2.5, 0.0, 0.0, -1.0, 3.0, None, -2.0, -0.0, float("inf"), 4.0, float("nan"), 5.0, 1e-300, 1e300, 0.01, 7.0]


def test_forward_targets_of_zero_prices_as_in_sql(spark, tmp_path):
    own, want = _as_sql(spark, tmp_path, "fwd_targets", _ODD)
    assert own == want and {"inf", "-inf", "nan"} <= {x for r in own for x in r if isinstance(x, str)}


def test_log_returns_of_zero_prices_as_in_sql(spark, tmp_path):
    own, want = _as_sql(spark, tmp_path, "ret_log", _ODD)
    assert own == want and {"inf", "-inf", "nan"} <= {x for r in own for x in r if isinstance(x, str)}
