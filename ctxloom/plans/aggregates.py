"""Target statistics by group, level and grouping set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions.aggregates import MOMENTS, STATS
from ..operators.levels import detect_keys, global_stats, level_stats, make_levels, moments_by_grouping_sets, with_extra_quantiles
from .base import lines, r, sql_r, sql_stat, table

Y = "l_extendedprice"
DIGITS = {"sum": 2, "var": 0}


def _one(stat: str):
    n = DIGITS.get(stat, 4)
    cast = (lambda c: c) if stat != "count" else (lambda c: c.cast("long"))
    sql = f"SELECT l_returnflag, {sql_r(sql_stat(stat, Y), n) if stat != 'count' else sql_stat(stat, Y)} AS {stat} FROM lineitem GROUP BY l_returnflag"

    @register(f"agg_{stat}", sql)
    def query(spark, sf_dir):
        out = level_stats(lines(spark, sf_dir, "l_returnflag", Y), ("l_returnflag",), Y, (stat,))
        return out.select("l_returnflag", (cast(F.col(stat)) if stat == "count" else r(stat, n)).alias(stat))

    return query


for _stat in STATS:
    _one(_stat)


def _selected(stats, n=4):
    return [F.col(s) if s == "count" else r(s, DIGITS.get(s, n)).alias(s) for s in stats]


def _sql_selected(stats, y):
    return ", ".join(f"{sql_stat(s, y) if s == 'count' else sql_r(sql_stat(s, y), DIGITS.get(s, 4))} AS {s}" for s in stats)


@register("agg_global_all", f"SELECT {_sql_selected(STATS, Y)} FROM lineitem")
def agg_global_all(spark, sf_dir):
    return global_stats(lines(spark, sf_dir, Y), Y, STATS).select(*_selected(STATS))


@register("agg_combined", f"SELECT l_returnflag, l_linestatus, {_sql_selected(STATS, Y)} FROM lineitem GROUP BY ALL")
def agg_combined(spark, sf_dir):
    by = ("l_returnflag", "l_linestatus")
    return level_stats(lines(spark, sf_dir, *by, Y), by, Y, STATS).select(*by, *_selected(STATS))


@register("agg_refined_quantiles", f"SELECT l_suppkey, {_sql_selected(('median', 'iqr', 'q05', 'q33', 'q95', 'count'), Y)} FROM lineitem GROUP BY l_suppkey")
def agg_refined_quantiles(spark, sf_dir):
    stats = ("median", "iqr", "q05", "q33", "q95", "count")
    return level_stats(lines(spark, sf_dir, "l_suppkey", Y), ("l_suppkey",), Y, stats, quantiles="refined").select("l_suppkey", *_selected(stats))


_NULLED = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"


def _nulled(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.expr(_NULLED).alias("y"))


@register("agg_min_group_count", f"SELECT l_partkey, {_sql_selected(('mean', 'std', 'count'), 'y')} FROM (SELECT l_partkey, {_NULLED} AS y FROM lineitem) GROUP BY l_partkey HAVING count(y) >= 26")
def agg_min_group_count(spark, sf_dir):
    stats = ("mean", "std", "count")
    return level_stats(_nulled(spark, sf_dir), ("l_partkey",), "y", stats, 26).select("l_partkey", *_selected(stats))


@register("agg_min_group_size", f"SELECT l_partkey, {_sql_selected(('mean', 'median'), 'y')} FROM (SELECT l_partkey, {_NULLED} AS y FROM lineitem) GROUP BY l_partkey HAVING count(*) >= 31")
def agg_min_group_size(spark, sf_dir):
    stats = ("mean", "median")
    return level_stats(_nulled(spark, sf_dir), ("l_partkey",), "y", stats, 31).select("l_partkey", *_selected(stats))


@register(
    "agg_null_keys",
    f"SELECT k, {_sql_selected(('mean', 'sum', 'count'), 'y')} FROM (SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS k, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS y FROM lineitem) GROUP BY k HAVING count(y) >= 1",
)
def agg_null_keys(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("k"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("y"))
    return level_stats(df, ("k",), "y", ("mean", "sum", "count")).select("k", *_selected(("mean", "sum", "count")))


_KEYS = ("l_returnflag", "l_linestatus", "l_suppkey")
_MOMENTS = ("mean", "std", "min", "max", "range", "count")


@register(
    "agg_levels_pairs",
    f"""SELECT CASE grouping(l_returnflag, l_linestatus, l_suppkey) WHEN 7 THEN 'global' WHEN 3 THEN 'l_returnflag' WHEN 5 THEN 'l_linestatus' WHEN 6 THEN 'l_suppkey'
      WHEN 1 THEN 'l_returnflag__l_linestatus' WHEN 2 THEN 'l_returnflag__l_suppkey' WHEN 4 THEN 'l_linestatus__l_suppkey' END AS level,
      l_returnflag, l_linestatus, l_suppkey, {_sql_selected(_MOMENTS, Y)} FROM lineitem
    GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_suppkey), (l_returnflag, l_linestatus), (l_returnflag, l_suppkey), (l_linestatus, l_suppkey)) HAVING count({Y}) >= 5""",
)
def agg_levels_pairs(spark, sf_dir):
    out = moments_by_grouping_sets(lines(spark, sf_dir, *_KEYS, Y), [(), *make_levels(_KEYS)], Y, _MOMENTS, 5)
    return out.select("level", *_KEYS, *_selected(_MOMENTS))


@register(
    "agg_extra_quartiles",
    f"""WITH s AS (SELECT l_partkey, avg({Y}) AS mean FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30), q AS (SELECT l_partkey, quantile_cont({Y}, 0.25) AS q25, quantile_cont({Y}, 0.75) AS q75 FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, {sql_r("mean")} AS mean, {sql_r("q25")} AS q25, {sql_r("q75")} AS q75 FROM s JOIN q USING (l_partkey)""",
)
def agg_extra_quartiles(spark, sf_dir):
    df = lines(spark, sf_dir, "l_partkey", Y)
    out = with_extra_quantiles(level_stats(df, ("l_partkey",), Y, ("mean",), 30), df, ("l_partkey",), Y)
    return out.select("l_partkey", *_selected(("mean", "q25", "q75")))


@register(
    "detect_categoricals",
    """WITH c AS (SELECT count(*) AS n, count(DISTINCT p_name) AS p_name, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_size) AS p_size, count(DISTINCT p_partkey) AS p_partkey FROM part),
    u AS (UNPIVOT (SELECT * EXCLUDE (n) FROM c) ON COLUMNS(*) INTO NAME key VALUE d)
    SELECT key FROM u, c WHERE d BETWEEN 2 AND 100 AND (key IN ('p_name', 'p_brand', 'p_type') OR d < 0.1 * c.n)""",
)
def detect_categoricals(spark, sf_dir):
    found = detect_keys(table(spark, sf_dir, "part"), ("p_retailprice",))
    return spark.createDataFrame([(k,) for k in found], "key string")


assert set(MOMENTS) <= set(STATS)
