"""Context statistics joined to rows: fitted, cross-fitted in random and time folds, with backoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..config import VARIANTS, ContextSpec
from ..functions.relative import ratio_features
from ..operators.backoff import backoff_summary
from ..operators.context import ContextEstimator, time_fold_audit
from .base import SQL_FOLD, line_fold, r, sql_r, sql_stat, table

ROW = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
Y = "l_extendedprice"
_ROW = ", ".join(ROW)
_CUT = "2000-01-01"


def _stats_sql(key: str, stats, having: str = "", source: str = "lineitem", y: str = Y) -> str:
    cols = ", ".join(f"{sql_stat(s, y)} AS {s}" for s in stats)
    return f"SELECT {key + ', ' if key else ''}{cols} FROM {source} {f'GROUP BY {key}' if key else ''} {having}"


def _single(name: str, stats):
    columns = ", ".join(f"{f'coalesce(k.{s}, g.{s})' if s == 'count' else sql_r(f'coalesce(k.{s}, g.{s})')} AS l_returnflag_{Y}_{s}" for s in stats)
    sql = f"""WITH k AS ({_stats_sql("l_returnflag", stats, f"HAVING count({Y}) >= 5")}), g AS ({_stats_sql("", stats)})
    SELECT {_ROW}, {columns} FROM lineitem l LEFT JOIN k ON l.l_returnflag IS NOT DISTINCT FROM k.l_returnflag, g"""

    @register(name, sql)
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem").select(*ROW, "l_returnflag", Y)
        out = ContextEstimator(ContextSpec(Y, ("l_returnflag",), stats, strategy="off")).fit(df).transform(df)
        return out.select(*ROW, *[F.col(f"l_returnflag_{Y}_{s}") if s == "count" else r(f"l_returnflag_{Y}_{s}").alias(f"l_returnflag_{Y}_{s}") for s in stats])

    return query


_single("ctx_single_mean", VARIANTS["full"])
for _v in ("target_mean", "mean_count", "mean_std_count"):
    _single(f"variant_{_v}", VARIANTS[_v])


_FULL = ("mean", "std", "count")


def _full_sql() -> str:
    train = f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{_CUT}')"
    having = f"HAVING count({Y}) >= 5"
    levels = {"l_returnflag": "f", "l_linestatus": "s", "l_returnflag__l_linestatus": "p"}
    stats = {"f": _stats_sql("l_returnflag", _FULL, having, train), "s": _stats_sql("l_linestatus", _FULL, having, train), "p": _stats_sql("l_returnflag, l_linestatus", _FULL, having, train), "g": _stats_sql("", _FULL, "", train)}
    # both single keys come before all rows; linestatus has the fewer values, so pairs fall back on it first
    chain = {"f": ["f", "g"], "s": ["s", "g"], "p": ["p", "s", "g"]}
    cols = []
    for name, a in levels.items():
        for s in _FULL:
            e = f"coalesce({', '.join(f'{c}.{s}' for c in chain[a])})"
            cols.append(f"{e if s == 'count' else sql_r(e)} AS {name}_{Y}_{s}")
    ctes = ", ".join(f"{k} AS ({v})" for k, v in stats.items())
    return f"""WITH {ctes} SELECT {_ROW}, {", ".join(cols)} FROM (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{_CUT}') l
    LEFT JOIN f ON l.l_returnflag = f.l_returnflag LEFT JOIN s ON l.l_linestatus = s.l_linestatus LEFT JOIN p ON l.l_returnflag = p.l_returnflag AND l.l_linestatus = p.l_linestatus, g"""


@register("ctx_full_transform", _full_sql())
def ctx_full_transform(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ROW, "l_returnflag", "l_linestatus", "l_shipdate", Y)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    model = ContextEstimator(ContextSpec(Y, ("l_returnflag", "l_linestatus"), _FULL, strategy="off")).fit(df.where(F.col("l_shipdate") < cut))
    out = model.transform(df.where(F.col("l_shipdate") >= cut))
    names = [f"{x}_{Y}_{s}" for x in ("l_returnflag", "l_linestatus", "l_returnflag__l_linestatus") for s in _FULL]
    return out.select(*ROW, *[F.col(n) if n.endswith("count") else r(n).alias(n) for n in names])


_PAIR = ("l_suppkey", "l_partkey")
_BACK = ("mean", "count")
_PAIR_CTES = f"""g AS ({_stats_sql("", _BACK)}), a AS ({_stats_sql("l_suppkey", _BACK, f"HAVING count({Y}) >= 5")}), b AS ({_stats_sql("l_partkey", _BACK, f"HAVING count({Y}) >= 5")}), p AS ({_stats_sql("l_suppkey, l_partkey", _BACK, f"HAVING count({Y}) >= 5")})"""
_PAIR_JOIN = "FROM lineitem l LEFT JOIN a ON l.l_suppkey = a.l_suppkey LEFT JOIN b ON l.l_partkey = b.l_partkey LEFT JOIN p ON l.l_suppkey = p.l_suppkey AND l.l_partkey = p.l_partkey, g"


def _backed(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ROW, Y)
    return ContextEstimator(ContextSpec(Y, _PAIR, _BACK, strategy="off", backoff_depth=True)).fit(df).transform(df)


_PAIR_NAMES = {"l_suppkey": "coalesce(a.{s}, g.{s})", "l_partkey": "coalesce(b.{s}, g.{s})", "l_suppkey__l_partkey": "coalesce(p.{s}, a.{s}, g.{s})"}


_FILLED = ", ".join(f"{sql_r(e.format(s='mean'))} AS {n}_{Y}_mean, {e.format(s='count')} AS {n}_{Y}_count" for n, e in _PAIR_NAMES.items())


@register("ctx_backoff", f"WITH {_PAIR_CTES} SELECT {', '.join('l.' + c for c in ROW)}, {_FILLED} {_PAIR_JOIN}")
def ctx_backoff(spark, sf_dir):
    out = _backed(spark, sf_dir)
    return out.select(*ROW, *[x for n in _PAIR_NAMES for x in (r(f"{n}_{Y}_mean").alias(f"{n}_{Y}_mean"), F.col(f"{n}_{Y}_count"))])


_DEPTHS = "CASE WHEN a.mean IS NOT NULL THEN 0 ELSE 1 END AS l_suppkey_backoff_depth, CASE WHEN b.mean IS NOT NULL THEN 0 ELSE 1 END AS l_partkey_backoff_depth, CASE WHEN p.mean IS NOT NULL THEN 0 ELSE 1 END AS l_suppkey__l_partkey_backoff_depth"


@register("ctx_backoff_depth", f"WITH {_PAIR_CTES} SELECT {', '.join('l.' + c for c in ROW)}, {_DEPTHS} {_PAIR_JOIN}")
def ctx_backoff_depth(spark, sf_dir):
    return _backed(spark, sf_dir).select(*ROW, *[f"{n}_backoff_depth" for n in _PAIR_NAMES])


@register(
    "ctx_backoff_summary",
    f"""WITH {_PAIR_CTES}, d AS (SELECT {_DEPTHS} {_PAIR_JOIN}), u AS (UNPIVOT d ON COLUMNS(*) INTO NAME name VALUE depth)
    SELECT replace(name, '_backoff_depth', '') AS level, {sql_r("avg(depth)")} AS mean_depth, max(depth) AS max_depth, {sql_r("avg(CASE WHEN depth > 0 THEN 1e0 ELSE 0e0 END)")} AS share_backed_off FROM u GROUP BY 1""",
)
def ctx_backoff_summary(spark, sf_dir):
    return backoff_summary(_backed(spark, sf_dir)).select("level", r("mean_depth").alias("mean_depth"), "max_depth", r("share_backed_off").alias("share_backed_off"))


_REL = ("mean", "std", "median", "q25", "q75")


@register(
    "ctx_relative",
    f"""WITH k AS ({_stats_sql("l_returnflag", _REL)}) SELECT {_ROW}, {sql_r(f"({Y} - mean) / (std + 1e-8)")} AS l_returnflag_{Y}_zscore, {sql_r(f"{Y} / (median + 1e-8)")} AS l_returnflag_{Y}_ratio,
    {sql_r(f"({Y} - q25) / (q75 - q25 + 1e-8)")} AS l_returnflag_{Y}_pct_position, {sql_r(f"{Y} - mean")} AS l_returnflag_{Y}_dev_from_mean FROM lineitem l JOIN k USING (l_returnflag)""",
)
def ctx_relative(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ROW, "l_returnflag", Y)
    out = ContextEstimator(ContextSpec(Y, ("l_returnflag",), _REL, strategy="off", relative=True)).fit(df).transform(df)
    names = [f"l_returnflag_{Y}_{s}" for s in ("zscore", "ratio", "pct_position", "dev_from_mean")]
    return out.select(*ROW, *[r(n).alias(n) for n in names])


@register("ctx_ratio_features", f"WITH k AS ({_stats_sql('l_suppkey', ('mean',))}) SELECT {_ROW}, {sql_r(f'greatest(least({Y} / CASE WHEN mean = 0 THEN 1 ELSE mean END, 10), -10)')} AS l_suppkey_{Y}_mean_ratio FROM lineitem JOIN k USING (l_suppkey)")
def ctx_ratio_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ROW, Y)
    out = ContextEstimator(ContextSpec(Y, ("l_suppkey",), ("mean",), 1, "off", global_stats=False)).fit(df).transform(df)
    return ratio_features(out, Y).select(*ROW, r(f"l_suppkey_{Y}_mean_ratio").alias(f"l_suppkey_{Y}_mean_ratio"))


# ---------------------------------------------------------------- random folds

_CF = ("mean", "median", "count")


def _cf_sql(columns: str, with_key: bool) -> str:
    having = f"HAVING count({Y}) >= 5"
    base = f"base AS (SELECT *, {SQL_FOLD} AS fold FROM lineitem)"
    per = lambda key, h: f"SELECT fold{', ' + key if key else ''}, {', '.join(f'{sql_stat(s, Y)} AS {s}' for s in _CF)} FROM base GROUP BY fold{', ' + key if key else ''} {h}"
    spread = lambda s, fill: f"avg({s}) AS {s}, {'coalesce(stddev_samp(' + s + '), 0)' if fill else 'stddev_samp(' + s + ')'} AS {s}_sd"
    others = lambda name, key, fill: f"SELECT f.fold{', ' + key if key else ''}, {spread('mean', fill)}, {spread('median', fill)}, CAST(sum(count) AS BIGINT) AS count FROM {name} p JOIN folds f ON p.fold <> f.fold GROUP BY f.fold{', ' + key if key else ''}"
    return f"""WITH {base}, folds AS (SELECT DISTINCT fold FROM base), pk AS ({per("l_suppkey", having)}), pg AS ({per("", "")}), k AS ({others("pk", "l_suppkey", True)}), g AS ({others("pg", "", False)})
    SELECT {', '.join('b.' + c for c in ROW)}, {columns} FROM base b LEFT JOIN k ON b.fold = k.fold AND b.l_suppkey = k.l_suppkey JOIN g ON b.fold = g.fold"""


def _crossfit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*ROW, Y)
    spec = ContextSpec(Y, ("l_suppkey",), _CF, strategy="random", n_folds=5)
    return ContextEstimator(spec, fold_of=lambda d: d.withColumn("fold", line_fold())).fit_transform(df)


@register("cf_random", _cf_sql(f"{sql_r('coalesce(k.mean, g.mean)')} AS l_suppkey_{Y}_mean, {sql_r('coalesce(k.median, g.median)')} AS l_suppkey_{Y}_median, coalesce(k.count, g.count) AS l_suppkey_{Y}_count", True))
def cf_random(spark, sf_dir):
    out, _ = _crossfit(spark, sf_dir)
    return out.select(*ROW, r(f"l_suppkey_{Y}_mean").alias(f"l_suppkey_{Y}_mean"), r(f"l_suppkey_{Y}_median").alias(f"l_suppkey_{Y}_median"), f"l_suppkey_{Y}_count")


@register("cf_random_foldvar", _cf_sql(f"{sql_r('k.mean_sd')} AS l_suppkey_{Y}_mean_fold_std, {sql_r('k.mean - 2 * k.mean_sd')} AS l_suppkey_{Y}_mean_fold_lower, {sql_r('k.median + 2 * k.median_sd')} AS l_suppkey_{Y}_median_fold_upper", True))
def cf_random_foldvar(spark, sf_dir):
    out, _ = _crossfit(spark, sf_dir)
    names = [f"l_suppkey_{Y}_mean_fold_std", f"l_suppkey_{Y}_mean_fold_lower", f"l_suppkey_{Y}_median_fold_upper"]
    return out.select(*ROW, *[r(n).alias(n) for n in names])


@register("cf_random_global", _cf_sql(f"{sql_r('g.mean')} AS global_{Y}_mean, {sql_r('g.median')} AS global_{Y}_median, g.count AS global_{Y}_count, {sql_r('g.mean_sd')} AS global_{Y}_mean_fold_std", True))
def cf_random_global(spark, sf_dir):
    out, _ = _crossfit(spark, sf_dir)
    names = [f"global_{Y}_mean", f"global_{Y}_median", f"global_{Y}_mean_fold_std"]
    return out.select(*ROW, *[r(n).alias(n) for n in names], f"global_{Y}_count")


@register(
    "cf_random_store",
    f"""WITH base AS (SELECT *, {SQL_FOLD} AS fold FROM lineitem), p AS (SELECT fold, l_suppkey, avg({Y}) AS mean, quantile_cont({Y}, 0.5) AS median, count({Y}) AS count FROM base GROUP BY fold, l_suppkey HAVING count({Y}) >= 5)
    SELECT l_suppkey, {sql_r("avg(mean)")} AS mean, {sql_r("avg(median)")} AS median, CAST(sum(count) AS BIGINT) AS count, {sql_r("coalesce(stddev_samp(mean), 0)")} AS mean_fold_std FROM p GROUP BY l_suppkey""",
)
def cf_random_store(spark, sf_dir):
    _, model = _crossfit(spark, sf_dir)
    return model.store[("l_suppkey",)].select("l_suppkey", r("mean").alias("mean"), r("median").alias("median"), "count", r("mean_fold_std").alias("mean_fold_std"))


# ---------------------------------------------------------------- time folds

OY = "o_totalprice"
_TIME = ("mean", "q80", "count")


def _time_sql(test: str, gap: int, longest: str, select: str | None = None) -> str:
    """Folds by position; test and longest are SQL over n."""
    having = f"HAVING count({OY}) >= 5"
    cols = ", ".join(f"{sql_stat(s, OY)} AS {s}" for s in _TIME)
    body = select or f"""SELECT o.o_orderkey, {sql_r("coalesce(k.mean, g.mean)")} AS o_orderpriority_{OY}_mean, {sql_r("coalesce(k.q80, g.q80)")} AS o_orderpriority_{OY}_q80, coalesce(k.count, g.count) AS o_orderpriority_{OY}_count
    FROM pos o LEFT JOIN b ON o.p >= b.vs AND o.p < b.ve LEFT JOIN k ON k.fold = b.fold AND k.o_orderpriority = o.o_orderpriority LEFT JOIN g ON g.fold = b.fold"""
    return f"""WITH pos AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders), c AS (SELECT count(*) AS n FROM orders), sz AS (SELECT n, {test} AS t FROM c),
    b AS (SELECT fold, n - (4 - fold) * t AS vs, n - (4 - fold) * t + t AS ve, n - (4 - fold) * t - {gap} AS te, greatest(0, n - (4 - fold) * t - {gap} - {longest}) AS ts FROM sz, (SELECT unnest([0, 1, 2, 3]) AS fold)),
    tr AS (SELECT b.fold, o.* FROM pos o JOIN b ON o.p >= b.ts AND o.p < b.te), k AS (SELECT fold, o_orderpriority, {cols} FROM tr GROUP BY ALL {having}), g AS (SELECT fold, {cols} FROM tr GROUP BY fold) {body}"""


def _time(spark, sf_dir, **more):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", OY)
    spec = ContextSpec(OY, ("o_orderpriority",), _TIME, n_folds=4, time_col="o_orderdate", tie_cols=("o_orderkey",), **more)
    out, _ = ContextEstimator(spec).fit_transform(df)
    return out.select("o_orderkey", *[F.col(f"o_orderpriority_{OY}_{s}") if s == "count" else r(f"o_orderpriority_{OY}_{s}").alias(f"o_orderpriority_{OY}_{s}") for s in _TIME])


@register("cf_time", _time_sql("n // 5", 0, "n"))
def cf_time(spark, sf_dir):
    return _time(spark, sf_dir, strategy="time")


@register("cf_rolling", _time_sql("greatest(1, n // 5)", 0, "greatest(2 * t, CAST(floor(0.8 * n) AS BIGINT))"))
def cf_rolling(spark, sf_dir):
    return _time(spark, sf_dir, strategy="rolling")


@register("cf_rolling_gap", _time_sql("least(700, greatest(1, n // 5))", 40, "1500"))
def cf_rolling_gap(spark, sf_dir):
    return _time(spark, sf_dir, strategy="rolling", test_size=700, gap=40, max_train_size=1500)


_AUDIT = """SELECT CAST(b.fold AS INTEGER) AS fold, count(*) FILTER (WHERE p >= ts AND p < te) AS train_size, count(*) FILTER (WHERE p >= vs AND p < ve) AS val_size,
  max(o_orderdate) FILTER (WHERE p >= ts AND p < te) AS train_max, min(o_orderdate) FILTER (WHERE p >= vs AND p < ve) AS val_min, max(o_orderdate) FILTER (WHERE p >= vs AND p < ve) AS val_max FROM pos, b GROUP BY b.fold"""


@register("cf_fold_audit", _time_sql("least(700, greatest(1, n // 5))", 40, "1500", _AUDIT))
def cf_fold_audit(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return time_fold_audit(df, ContextSpec("o_totalprice", ("o_orderpriority",), strategy="rolling", n_folds=4, time_col="o_orderdate", tie_cols=("o_orderkey",), test_size=700, gap=40, max_train_size=1500))
