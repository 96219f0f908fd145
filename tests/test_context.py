import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.config import CleanupSpec, ContextSpec, LagSpec, WalkForwardSpec, variant
from ctxloom.functions import aggregates
from ctxloom.functions.aggregates import STATS, refined_quantiles
from ctxloom.operators.backoff import apply_backoff, fallback_chain
from ctxloom.operators.cleanup import Cleanup, parse_feature
from ctxloom.operators.context import ContextEstimator
from ctxloom.operators.folds import cut_position, positions, time_bounds
from ctxloom.operators.levels import detect_keys, level_stats, make_levels


def test_levels_and_names():
    assert make_levels(("a", "b", "c")) == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")]
    assert make_levels(("a", "b", "c"), allowed=(("c", "a"),)) == [("a",), ("b",), ("c",), ("a", "c")]
    assert make_levels(("a", "b"), interactions=False) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        make_levels(("a__b",))
    assert parse_feature("a__b_y_q05", "y") == (("a", "b"), "q05") and parse_feature("global_y_mean", "y") == ((), "mean")


@pytest.mark.parametrize("bad", [{"n_folds": 1}, {"min_group_size": 0}, {"strategy": "time"}, {"strategy": "what"}, {"gap": -1}, {"test_size": 0}, {"fold_features": ("max",)}, {"stats": ("mode",)}, {"n_folds": 2}, {"keys": ("global",)}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        ContextSpec("y", **({"keys": ("k",)} | bad))


def test_other_settings():
    with pytest.raises(ValueError):
        LagSpec((0,))
    with pytest.raises(ValueError):
        WalkForwardSpec(step=0)
    assert variant("Mean-Count") == ("mean", "count")


def test_own_value_never_counts(spark):
    """One city has a single row per fold: its context comes from the other folds alone."""
    rows = [(k, "A", 100.0 + k) for k in range(10)] + [(10 + k, "C", v) for k, v in enumerate((503.0, 601.0, 709.0, 811.0, 907.0))]
    df = spark.createDataFrame(rows, "id long, city string, price double")
    out, _ = ContextEstimator(ContextSpec("price", ("city",), ("mean", "count"), 1), ("id",), lambda d: d.withColumn("fold", (F.col("id") % 5).cast("int"))).fit_transform(df)
    for r in out.where("city = 'C'").collect():
        others = [v for v in (503.0, 601.0, 709.0, 811.0, 907.0) if v != r.price]
        assert r.city_price_mean == pytest.approx(sum(others) / 4) and r.city_price_count == 4
        assert r.city_price_mean != r.price
    assert out.count() == 15


def test_time_folds_see_the_past_only(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", float(k)) for k in range(30)], "t long, g string, y double")
    out, model = ContextEstimator(ContextSpec("y", ("g",), ("max", "count"), 1, "time", 4, time_col="t")).fit_transform(df)
    rows = {r.t: r for r in out.collect()}
    assert len(rows) == 30 and all(rows[t].g_y_max is None for t in range(6))
    for t in range(6, 30):
        start = 6 + (t - 6) // 6 * 6
        assert rows[t].global_y_max == start - 1 and rows[t].g_y_max < start
    assert model.transform(df).where("g_y_count = 15").count() == 30


def test_backoff_chain_and_depth(spark):
    chain = fallback_chain(("a", "b", "c"), {"a": 9, "b": 2, "c": 5}, {("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")})
    assert chain == [("b", "c"), ("a", "b"), ("a", "c"), ("b",), ("c",), ("a",), ()]
    df = spark.createDataFrame([(1, None, 150.0, 160.0, 200.0), (2, 180.0, 150.0, 160.0, 200.0), (3, None, None, None, 200.0)], "id long, a__b_y_mean double, a_y_mean double, b_y_mean double, global_y_mean double")
    out = {r.id: r for r in apply_backoff(df, [("a",), ("b",), ("a", "b")], "y", ("mean",), {"a": 3, "b": 9}, True).collect()}
    assert [out[k].a__b_y_mean for k in (1, 2, 3)] == [150.0, 180.0, 200.0] and [out[k].a__b_backoff_depth for k in (1, 2)] == [1, 0] and out[3].a_backoff_depth == 1


def test_unseen_groups_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, y double")
    model = ContextEstimator(ContextSpec("y", ("k",), ("mean",), 1, "off")).fit(df)
    got = {r.k: r.k_y_mean for r in model.transform(spark.createDataFrame([("a",), (None,), ("new",)], "k string")).collect()}
    assert got == {"a": 2.0, None: 6.0, "new": 4.0}
    with pytest.raises(ValueError):
        model.transform(spark.createDataFrame([(1,)], "other int"))


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.integers(2, 9))
@settings(max_examples=15, deadline=None)
def test_refined_quantiles_are_exact(spark, values, slots):
    df = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(values)], "g int, y double")
    probs = (0.05, 0.33, 0.5, 0.95)
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("y", F.array(*map(F.lit, probs))).alias("p")).collect()}
    got = {r.g: r["__p"] for r in refined_quantiles(df, ["g"], "y", probs, slots).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_refined_quantiles_with_outliers_and_one_group(spark, monkeypatch):
    """One group holds all rows; outliers of any size leave the other values in many ranges."""
    df = spark.range(4000).selectExpr("'g' AS g", "CASE WHEN id = 7 THEN 1e300 WHEN id = 9 THEN -1e200 WHEN id % 10 = 0 THEN 0.0 ELSE pmod(id * 7919, 4001) / 4001 - 0.3 END AS y")
    probs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    want = df.agg(F.percentile("y", F.array(*map(F.lit, probs)))).first()[0]
    for keys in (["g"], []):
        got = refined_quantiles(df, keys, "y", probs).first()["__p"]
        assert all(a == pytest.approx(b, rel=1e-12, abs=1e-12) for a, b in zip(got, want))
    monkeypatch.setattr(aggregates, "HELD_AT_ONCE", 100)
    assert aggregates.group_is_large(df, ["g"]) and not aggregates.group_is_large(df.limit(50), [])
    assert level_stats(df, ("g",), "y", ("median", "count")).first()["median"] == pytest.approx(want[3])
    assert aggregates.quantiles_of(df, [], "y", probs).first()["__p"][3] == pytest.approx(want[3])
    assert aggregates.quantiles_of(df.where("y IS NULL"), [], "y", probs).first() is None


def test_all_statistics_of_a_known_group(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)] + [("g", None)], "k string, y double")
    r = level_stats(df, ("k",), "y", STATS).first()
    assert (r.mean, r.median, r.min, r.max, r.range, r["count"], r.sum, r.iqr, r.q25) == (2.5, 2.5, 1, 4, 3, 4, 10, 1.5, 1.75)
    assert r.std == pytest.approx(math.sqrt(1.25)) and r.var == 1.25 and r.cv == pytest.approx(math.sqrt(1.25) / (2.5 + 1e-8))


def test_fold_bounds():
    assert [b["val_start"] for b in time_bounds(30, 4)] == [6, 12, 18, 24]
    rolled = time_bounds(100, 3, test_size=999, gap=5, rolling=True)
    assert [(b["val_start"], b["train_end"]) for b in rolled] == [(25, 20), (50, 45), (75, 70)]
    assert cut_position(5, 0.5) == 2 and cut_position(2, 0.99) == 1
    with pytest.raises(ValueError):
        time_bounds(3, 5)


def test_positions_number_all_rows(spark):
    df = spark.range(5000).selectExpr("id", "pmod(id * 7919, 5000) AS v")
    assert positions(df, ["v"]).where("v <> position").count() == 0
    wide = spark.range(200_000, numPartitions=7).selectExpr("id", "CASE WHEN id >= 3 THEN pmod(id * 7919, 200000) DIV 50 END AS v")
    got = positions(wide, ["v", "id"]).orderBy("v", "id")
    assert got.where("v IS NULL AND position > 2").isEmpty() and got.agg(F.count_distinct("position"), F.max("position")).first()[:] == (200_000, 199_999)
    assert got.where("v IS NOT NULL AND (position - 3 < v * 50 - 3 OR position > v * 50 + 53)").isEmpty()


def test_detected_keys(spark):
    df = spark.createDataFrame([(k % 3, str(k % 4), k, "x", k * 1.0, k % 2 == 0) for k in range(100)], "a int, b string, c int, d string, e double, f boolean")
    assert detect_keys(df) == ["a", "b", "f"] and detect_keys(df, ("a",)) == ["b", "f"]


def test_cleanup_reasons_and_replay(spark):
    df = spark.range(200).selectExpr("double(id) AS y", "double(id) * 2 AS leak", "1.0 AS flat", "double(pmod(id * 37, 50)) AS u", "double(pmod(id * 37, 50)) + 0.001 * pmod(id, 2) AS v", "double(pmod(id * 101, 17)) AS w")
    c = Cleanup(CleanupSpec(), "y").fit(df)
    assert c.dropped["constant"] == ["flat"] and c.dropped["leakage"] == ["leak"] and len(c.dropped["correlated"]) == 1 and c.dropped["correlated"][0] in "uv"
    assert set(c.transform(df).columns) == {"y", "w", *({"u", "v"} - set(c.dropped["correlated"]))} and 0 < c.removal_rate < 1
    e = Cleanup(CleanupSpec(use_vif=True, correlation=0.9999999), "y").fit(df)
    assert "vif" in e.dropped


def test_no_targets_and_no_rows(spark):
    """Without any target all context is null, and no row is lost."""
    df = spark.createDataFrame([("a", None, 1), ("b", None, 2)], "k string, y double, id int")
    for stats in (("mean", "median"), ("mean", "q05", "count")):
        for strategy in ("off", "random"):
            out, model = ContextEstimator(ContextSpec("y", ("k",), stats, 1, strategy, 3), ("id",)).fit_transform(df)
            assert out.count() == 2 and out.where("k_y_mean IS NOT NULL").isEmpty() and model.transform(df).count() == 2
            assert ContextEstimator(ContextSpec("y", ("k",), stats, 1, strategy, 3), ("id",)).fit_transform(df.limit(0))[0].count() == 0
