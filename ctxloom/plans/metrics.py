"""Forecast accuracy and portfolios: orders as predictions (time o_orderdate, name o_orderkey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import linalg, metrics, reports
from ..operators.cleanup import Cleanup
from ..operators.selection import lm_statistics
from ..config import CleanupSpec
from .base import r, sql_r, table

#: pred and ret are whole-number hashes of the key, scaled: alike in both engines.
_P = "SELECT o_orderkey, o_orderdate, o_custkey % 3 + 1 AS horizon, (o_orderkey * 7919 % 1000) / 1e3 - 5e-1 AS pred, (o_orderkey * 104729 % 997) / 1e3 - 49e-2 AS ret, o_custkey % 4 AS fold FROM orders"


def predictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 3 + 1).alias("horizon"), (key * 7919 % 1000 / 1e3 - 0.5).alias("pred"), (key * 104729 % 997 / 1e3 - 0.49).alias("ret"), (F.col("o_custkey") % 4).alias("fold"))


_ACC = "sqrt(avg(pow(pred - ret, 2))) AS rmse, avg(abs(pred - ret)) AS mae, avg(CASE WHEN sign(pred) = sign(ret) THEN 1e0 ELSE 0e0 END) AS hit_rate"


def _round(df, keys, names, n=6):
    return df.select(*keys, *[r(x, n).alias(x) for x in names])


@register("accuracy_metrics", f"WITH p AS ({_P}), a AS (SELECT horizon, {_ACC}, count(*) AS n FROM p GROUP BY horizon) SELECT horizon, {', '.join(sql_r(x, 6) + ' AS ' + x for x in ('rmse', 'mae', 'hit_rate'))}, n FROM a")
def accuracy_metrics(spark, sf_dir):
    return _round(metrics.accuracy(predictions(spark, sf_dir), "ret", "pred", ["horizon"]), ["horizon", "n"], ["rmse", "mae", "hit_rate"])


_ACROSS = [f"{x}_{s}" for x in ("rmse", "mae", "hit_rate") for s in ("mean", "std")]


@register("accuracy_across_folds", f"WITH p AS ({_P}), a AS (SELECT horizon, fold, {_ACC} FROM p GROUP BY horizon, fold) SELECT horizon, {', '.join(f'{sql_r(f'avg({x})', 6)} AS {x}_mean, {sql_r(f'coalesce(stddev_samp({x}), 0)', 6)} AS {x}_std' for x in ('rmse', 'mae', 'hit_rate'))}, count(*) AS n_folds FROM a GROUP BY horizon")
def accuracy_across_folds(spark, sf_dir):
    per = metrics.accuracy(predictions(spark, sf_dir), "ret", "pred", ["horizon", "fold"])
    return _round(metrics.across_folds(per, ["horizon"]), ["horizon", "n_folds"], _ACROSS)


_LS = f"""p AS ({_P}), k AS (SELECT *, row_number() OVER (PARTITION BY horizon, o_orderdate ORDER BY pred, o_orderkey) AS rk, count(*) OVER (PARTITION BY horizon, o_orderdate) AS n FROM p),
q AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE greatest(((rk - 1) * least(10, n) + n - 2) // (n - 1) - 1, 0) END AS bin2 FROM k),
ls AS (SELECT horizon, o_orderdate, CASE WHEN n >= 2 THEN avg(ret) FILTER (WHERE bin2 = least(10, n) - 1) - avg(ret) FILTER (WHERE bin2 = 0) END AS long_short, n FROM q GROUP BY horizon, o_orderdate, n)"""


def _ls(spark, sf_dir):
    return metrics.long_short(predictions(spark, sf_dir), "o_orderdate", "pred", "ret", "o_orderkey", by=("horizon",))


@register("decile_ls", f"WITH {_LS} SELECT horizon, o_orderdate, {sql_r('long_short', 6)} AS long_short, n FROM ls")
def decile_ls(spark, sf_dir):
    return _round(_ls(spark, sf_dir), ["horizon", "o_orderdate", "n"], ["long_short"])


@register("quantile_bins", f"WITH {_LS} SELECT o_orderkey, CAST(bin2 AS INTEGER) AS bin FROM q")
def quantile_bins(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("horizon", "o_orderdate")
    ranked = predictions(spark, sf_dir).select("o_orderkey", F.row_number().over(w.orderBy("pred", "o_orderkey")).alias("rk"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.select("o_orderkey", metrics.bins(F.col("rk"), F.col("n")).alias("bin"))


_SHARPE = "avg(long_short) / stddev_samp(long_short) * sqrt(252e0)"
_SORTINO = "avg(long_short) / stddev_samp(CASE WHEN long_short < 0 THEN long_short END) * sqrt(252e0)"


@register("sharpe", f"WITH {_LS} SELECT horizon, {sql_r(_SHARPE, 6)} AS sharpe FROM ls GROUP BY horizon")
def sharpe(spark, sf_dir):
    return _ls(spark, sf_dir).groupBy("horizon").agg(r(metrics.sharpe(F.col("long_short")), 6).alias("sharpe"))


@register("sortino", f"WITH {_LS} SELECT horizon, {sql_r(_SORTINO, 6)} AS sortino FROM ls GROUP BY horizon")
def sortino(spark, sf_dir):
    return _ls(spark, sf_dir).groupBy("horizon").agg(r(metrics.sortino(F.col("long_short")), 6).alias("sortino"))


@register("portfolio_summary", f"WITH {_LS} SELECT horizon, {sql_r('avg(long_short)', 6)} AS mean, {sql_r('stddev_samp(long_short)', 6)} AS std, {sql_r(_SHARPE, 6)} AS sharpe, {sql_r(_SORTINO, 6)} AS sortino, count(*) AS n_periods FROM ls WHERE long_short IS NOT NULL GROUP BY horizon")
def portfolio_summary(spark, sf_dir):
    return _round(metrics.portfolio(_ls(spark, sf_dir), ["horizon"]), ["horizon", "n_periods"], ["mean", "std", "sharpe", "sortino"])


@register("select_horizon", f"WITH {_LS}, s AS (SELECT horizon, {_SHARPE} AS sharpe FROM ls GROUP BY horizon) SELECT horizon, {sql_r('sharpe', 6)} AS sharpe FROM s ORDER BY s.sharpe DESC NULLS LAST, horizon LIMIT 1")
def select_horizon(spark, sf_dir):
    scores = metrics.portfolio(_ls(spark, sf_dir), ["horizon"])
    return _round(metrics.select_horizon(scores, "sharpe"), ["horizon"], ["sharpe"])


@register("coverage", f"WITH p AS ({_P}) SELECT horizon, {sql_r('avg(CASE WHEN ret BETWEEN pred - 3e-1 AND pred + 3e-1 THEN 1e0 ELSE 0e0 END)', 6)} AS coverage, count(*) AS n FROM p GROUP BY horizon")
def coverage(spark, sf_dir):
    p = predictions(spark, sf_dir).select("horizon", "ret", (F.col("pred") - 0.3).alias("lo"), (F.col("pred") + 0.3).alias("hi"))
    return _round(metrics.coverage(p, "ret", "lo", "hi", ["horizon"]), ["horizon", "n"], ["coverage"])


@register("baseline_comparison", f"WITH p AS ({_P}), b AS (SELECT fold, sqrt(avg(pow(0 - ret, 2))) AS base FROM p GROUP BY fold), c AS (SELECT fold, sqrt(avg(pow(pred - ret, 2))) AS ctx FROM p GROUP BY fold) SELECT fold, {sql_r('base', 6)} AS base_rmse, {sql_r('ctx', 6)} AS context_rmse, {sql_r('ctx - base', 6)} AS delta_rmse, {sql_r('(base - ctx) / base * 100', 4)} AS improvement FROM b JOIN c USING (fold)")
def baseline_comparison(spark, sf_dir):
    p = predictions(spark, sf_dir)
    base = metrics.accuracy(p.withColumn("pred", F.lit(0.0)), "ret", "pred", ["fold"])
    both = metrics.comparison(base, metrics.accuracy(p, "ret", "pred", ["fold"]), ["fold"], ("rmse",))
    return both.select("fold", *[r(c, 6).alias(c) for c in ("base_rmse", "context_rmse", "delta_rmse")], r(metrics.improvement(F.col("base_rmse"), F.col("context_rmse")), 4).alias("improvement"))


# ---------------------------------------------------------------- feature statistics

_NUMERIC = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


@register("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sql_r(f'corr({a}, {b})', 6)} AS corr FROM lineitem" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]))
def corr_matrix(spark, sf_dir):
    m = linalg.correlation_matrix(table(spark, sf_dir, "lineitem"), list(_NUMERIC))
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(_NUMERIC) for j, b in enumerate(_NUMERIC) if i < j]
    return spark.createDataFrame(rows, "a string, b string, corr double").select("a", "b", r("corr", 6).alias("corr"))


def _features(spark, sf_dir):
    """Features with a constant, a leaking one, and a repeated one."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(price.alias("y"), quantity.alias("quantity"), (quantity * 2 + 1).alias("repeated"), F.lit(3.0).alias("constant"), (price * 1.5 + F.col("l_tax")).alias("leak"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@register("cleanup_constant", "SELECT 'constant' AS feature WHERE (SELECT var_samp(3e0) FROM lineitem) < 1e-10")
def cleanup_constant(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in Cleanup(CleanupSpec(), "y").fit(_features(spark, sf_dir)).dropped["constant"]], "feature string")


@register("cleanup_leakage", "SELECT 'leak' AS feature WHERE (SELECT abs(corr(l_extendedprice * 1.5e0 + l_tax, l_extendedprice)) FROM lineitem) > 0.95")
def cleanup_leakage(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in Cleanup(CleanupSpec(), "y").fit(_features(spark, sf_dir)).dropped["leakage"]], "feature string")


@register("cleanup_correlated", "SELECT 'repeated' AS feature WHERE (SELECT abs(corr(l_quantity, l_quantity * 2 + 1)) FROM lineitem) > 0.9")
def cleanup_correlated(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in Cleanup(CleanupSpec(), "y").fit(_features(spark, sf_dir)).dropped["correlated"]], "feature string")




@register(
    "ols_stats",
    f"""WITH s AS (SELECT corr(l_extendedprice, l_quantity) AS rr, count(*) AS n FROM lineitem) SELECT 'quantity' AS feature, {sql_r("rr", 6)} AS coefficient, {sql_r("sqrt((1 - rr * rr) / (n - 2))", 6)} AS std_error, {sql_r("rr * sqrt((n - 2) / (1 - rr * rr))", 3)} AS t_value, {sql_r("rr", 6)} AS pearson_r, {sql_r("rr * rr", 6)} AS r_squared FROM s""",
)
def ols_stats(spark, sf_dir):
    stats = lm_statistics(_features(spark, sf_dir), ["quantity"], "y")
    rows = [(s.feature, s.coefficient, s.std_error, s.t_value, s.pearson_r, s.r_squared) for s in stats.features]
    df = spark.createDataFrame(rows, "feature string, coefficient double, std_error double, t_value double, pearson_r double, r_squared double")
    return df.select("feature", r("coefficient", 6).alias("coefficient"), r("std_error", 6).alias("std_error"), r("t_value", 3).alias("t_value"), r("pearson_r", 6).alias("pearson_r"), r("r_squared", 6).alias("r_squared"))


# ---------------------------------------------------------------- report rollups


def _importances(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("feature"), F.col("p_type").alias("strategy"), (F.col("p_size") * 1.0).alias("importance"), "p_partkey")


_IMP = "SELECT p_brand AS feature, p_type AS strategy, p_size * 1e0 AS importance, p_partkey FROM part"


@register("importance_summary", f"WITH i AS ({_IMP}) SELECT feature, {sql_r('avg(importance)', 6)} AS mean, {sql_r('stddev_pop(importance)', 6)} AS std, count(*) AS n, {', '.join(f'{sql_r(f'quantile_cont(importance, {p})', 6)} AS p{int(p * 100)}' for p in (0.1, 0.5, 0.9))}, string_agg(DISTINCT strategy, '|' ORDER BY strategy) AS strategies FROM i GROUP BY feature")
def importance_summary(spark, sf_dir):
    return _round(reports.importance_summary(_importances(spark, sf_dir)), ["feature", "n", "strategies"], ["mean", "std", "p10", "p50", "p90"])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("pivot_strategy", f"WITH i AS ({_IMP}) SELECT feature, {', '.join(f'{sql_r(f"avg(importance) FILTER (WHERE strategy = {chr(39)}{t}{chr(39)})", 6)} AS {t}' for t in _TYPES)} FROM i GROUP BY feature")
def pivot_strategy(spark, sf_dir):
    return _round(reports.pivoted(_importances(spark, sf_dir), ["feature"], "strategy", "importance", _TYPES), ["feature"], _TYPES)


@register("topk_per_group", f"WITH i AS ({_IMP}), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY importance DESC, p_partkey) AS rank FROM i) SELECT feature, p_partkey, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    return reports.top_by_group(_importances(spark, sf_dir), ["feature"], "importance", ["p_partkey"], 3).select("feature", "p_partkey", "rank")


@register("win_counts", f"WITH i AS (SELECT strategy, feature, min(importance) AS s FROM ({_IMP}) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY s, feature) AS rk FROM i) SELECT feature, count(*) AS wins FROM k WHERE rk = 1 GROUP BY feature")
def win_counts(spark, sf_dir):
    best = _importances(spark, sf_dir).groupBy("strategy", "feature").agg(F.min("importance").alias("s"))
    return reports.win_counts(best, ["strategy"], "feature", "s")


@register("mean_ranks", f"WITH i AS (SELECT strategy, feature, avg(importance) AS s FROM ({_IMP}) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY s, feature) AS rk FROM i) SELECT feature, {sql_r('avg(rk)', 6)} AS mean_rank, count(*) AS contests FROM k GROUP BY feature ORDER BY avg(rk), feature LIMIT 10")
def mean_ranks(spark, sf_dir):
    scores = _importances(spark, sf_dir).groupBy("strategy", "feature").agg(F.avg("importance").alias("s"))
    return _round(reports.mean_ranks(scores, ["strategy"], "feature", "s"), ["feature", "contests"], ["mean_rank"])


@register("dominance", f"WITH i AS ({_IMP}) SELECT {sql_r('(SELECT sum(importance) FROM (SELECT importance FROM i ORDER BY importance DESC, p_partkey LIMIT 3)) / (SELECT sum(importance) FROM i)', 6)} AS top_share, false AS dominated")
def dominance(spark, sf_dir):
    return _round(reports.dominance(_importances(spark, sf_dir), "importance", "p_partkey"), ["dominated"], ["top_share"])


@register("rollup_table", f"WITH i AS ({_IMP}) SELECT feature, strategy, {sql_r('avg(importance)', 6)} AS mean, min(importance) AS min, max(importance) AS max, count(*) AS n FROM i GROUP BY ALL")
def rollup_table(spark, sf_dir):
    return _round(reports.rollup_table(_importances(spark, sf_dir), ["feature", "strategy"], "importance"), ["feature", "strategy", "min", "max", "n"], ["mean"])


@register("target_profile", " UNION ALL ".join(f"SELECT {p}::DOUBLE AS probability, {sql_r(f'quantile_cont(l_extendedprice, {p})')} AS value FROM lineitem" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)))
def target_profile(spark, sf_dir):
    return _round(reports.target_profile(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)), ["probability"], ["value"], 4)


@register("split_summary", f"SELECT CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'test' ELSE 'train' END AS split, min(o_totalprice) AS min, max(o_totalprice) AS max, {sql_r('avg(o_totalprice)')} AS mean, {sql_r('stddev_samp(o_totalprice)')} AS std, count(o_totalprice) AS n FROM orders GROUP BY 1")
def split_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("split", F.when(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), "test").otherwise("train"))
    return _round(reports.split_summary(o, "split", "o_totalprice"), ["split", "min", "max", "n"], ["mean", "std"], 4)


@register("feature_usage", f"WITH i AS ({_IMP}), t AS (SELECT [strategy, feature] AS fs FROM i ORDER BY importance, p_partkey LIMIT 20) SELECT feature, count(*) AS n_results FROM (SELECT unnest(fs) AS feature FROM t) GROUP BY feature")
def feature_usage(spark, sf_dir):
    rows = _importances(spark, sf_dir).withColumn("fs", F.array("strategy", "feature"))
    return reports.feature_usage(rows, "fs", "importance", "p_partkey")


_SIDE = "CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'test' ELSE 'train' END"


def _apart(f: str) -> str:
    return sql_r(f"abs({f}(o_totalprice) FILTER ({_SIDE} = 'train') - {f}(o_totalprice) FILTER ({_SIDE} = 'test'))")


@register("split_differences", f"SELECT {_apart('avg')} AS mean_difference, {_apart('stddev_samp')} AS std_difference FROM orders")
def split_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("split", F.expr(_SIDE))
    return _round(reports.split_differences(o, "split", "o_totalprice"), [], ["mean_difference", "std_difference"], 4)
