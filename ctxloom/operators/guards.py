"""Leakage guards: each gives the rows that violate a rule, so no rows means pass."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import decayed


def passed(violations: DataFrame) -> bool:
    return violations.isEmpty()


def report(violations: DataFrame, show: int = 20) -> dict:
    """Verdict, count, and a few examples."""
    n = violations.count()
    return {"pass": n == 0, "n_violations": n, "violations": [r.asDict() for r in violations.limit(show).collect()]}


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """Whether values differ beyond tolerance; null on one side only is a difference."""
    return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))


def lookahead_violations(features: DataFrame, recomputed: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, indicator, stored, recomputed) where stored indicators are not those of past rows alone."""
    right = recomputed.select(*keys, *[F.col(n).alias(f"__r_{n}") for n in names])
    both = features.select(*keys, *names).join(right, keys, "left")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).cast("double").alias("stored"), F.col(f"__r_{n}").cast("double").alias("recomputed")) for n in names])).alias("v")
    return both.select(*keys, each).select(*keys, "v.*").where(differs(F.col("stored"), F.col("recomputed"), tolerance))


def spoiled_violations(prices: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], ts: str, cut: str, names: list[str], values: list[str]) -> DataFrame:
    """Rows up to a cut whose indicators change once the values from the cut on are changed: those looked ahead, or at their own row.

    cut is a column of prices, one time per group; build makes the indicators, and keeps ts and cut.
    """
    changed = prices.withColumns({v: F.when(F.col(ts) >= F.col(cut), F.col(v) * 3 + 7).otherwise(F.col(v)) for v in values})
    seen = lambda d: build(d).where(F.col(ts) <= F.col(cut))
    return lookahead_violations(seen(prices), seen(changed), keys, names)


def pit_violations(joined: DataFrame, published: str = "published_at", close: str = "period_close_ts") -> DataFrame:
    """Articles published after the close they are bound to, or without one."""
    return joined.where(F.col(published).isNull() | F.col(close).isNull() | (F.col(published) > F.col(close)))


def tightness_violations(joined: DataFrame, sessions: DataFrame, published: str = "published_at") -> DataFrame:
    """Articles bound to a session although an earlier one closed at or after them."""
    return joined.join(sessions, "period_close_ts").where(F.col(published) <= F.col("previous_close"))


def fk_violations(joined: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    return joined.join(prices.select(*keys).distinct(), keys, "left_anti")


def prob_sum_violations(scored: DataFrame, parts: tuple[str, ...] = ("pos", "neg", "neu"), tolerance: float = 1e-6) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return scored.where(F.coalesce(F.isnan(total) | (F.abs(total - 1) > tolerance), F.lit(True)))


def monotone_violations(weighted: DataFrame, by: list[str], order: str, weight: str = "weight", tolerance: float = 1e-12) -> DataFrame:
    """Rows whose weight is below that of an earlier publication in their group."""
    w = Window.partitionBy(*by).orderBy(order)
    return weighted.withColumn("previous_weight", F.lag(weight).over(w)).where(F.col(weight) < F.col("previous_weight") - tolerance)


def stale_cache_violations(articles: DataFrame, cache: DataFrame, key: str = "article_key") -> DataFrame:
    """Cached scores whose key no article has any more."""
    return cache.join(articles.select(key).distinct(), key, "left_anti")


def reproducible_violations(scored: DataFrame, aggregate: DataFrame, values: list[str], by: list[str], tau: float = 5.0, tolerance: float = 1e-6) -> DataFrame:
    """Groups whose stored aggregate differs from a fresh one, is missing, or has nothing behind it."""
    fresh = decayed(scored, values, by, tau).select(*by, *[F.col(v).alias(f"__f_{v}") for v in values], F.lit(True).alias("__fresh"))
    both = aggregate.withColumn("__stored", F.lit(True)).join(fresh, by, "full")
    apart = reduce(lambda a, b: a | b, [differs(F.col(v), F.col(f"__f_{v}"), tolerance) for v in values])
    problem = F.when(F.col("__stored").isNull(), "missing").when(F.col("__fresh").isNull(), "unfounded").when(apart, "differs")
    return both.select(*by, problem.alias("problem")).where("problem IS NOT NULL")


def target_columns(names: list[str], horizons: tuple[int, ...] | None = None) -> list[str]:
    """Names of forward targets among feature columns; their lags and rolls count as well."""
    found = [(n, int(m[1])) for n in names if (m := re.search(r"(?:^|_)(?:ret|resid)_h(\d+)(?:_|$)", n))]
    return [n for n, h in found if horizons is None or h in horizons]


# Prefixes that a design matrix must not have.
BLOCKED = ("ret_h", "pred_h", "pred_sector_h", "pred_resid_h", "resid_h")


def design_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that may be features."""
    from .cleanup import numeric_columns

    return [c for c in numeric_columns(df, exclude) if not c.startswith(BLOCKED)]


def fold_violations(folds: DataFrame) -> DataFrame:
    """Walk-forward folds that overlap or step back: (fold_idx, problem)."""
    w = Window.orderBy("fold_idx")  # one row per fold
    folds = folds.withColumn("__next", F.lead("val_min").over(w))
    checks = [
        (F.col("train_max") >= F.col("val_min"), "train reaches into validation"),
        (F.col("val_min") > F.col("val_max"), "validation is reversed"),
        (F.col("__next") <= F.col("val_min"), "folds do not advance"),
    ]
    if "test_min" in folds.columns:
        checks += [(F.col("val_max") >= F.col("test_min"), "validation reaches into test"), (F.col("test_min") > F.col("test_max"), "test is reversed")]
    problems = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))).alias("problem")
    return folds.select("fold_idx", problems)


def survivors(universe: DataFrame, delisted: str = "delisted_at", least: int = 13) -> DataFrame:
    """How many rows have a readable end date, and whether that is enough: a universe with hardly any holds survivors alone."""
    n = F.count(F.expr(f"try_to_date({delisted})"))
    return universe.agg(n.alias("n_delisted"), (n >= least).alias("passed"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def values_in_order(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """What permuted deals out: the column's values with their place in key order, the same for every seed."""
    from .folds import positions

    return positions(df.select(*key, F.col(column).alias("__value")), key, "__place").select("__place", "__value")


def permuted(df: DataFrame, column: str, key: list[str], seed: int, values: DataFrame | None = None) -> DataFrame:
    """df with the column's values dealt to other rows, by two global orders; values are those of values_in_order, if there already."""
    from .folds import pieces, positions

    # names that stay clear of the columns of df
    placed = positions(df.withColumn("__row_h", F.xxhash64(F.lit(seed), *map(F.col, key))), ["__row_h", *key], "__place", hashed=True).drop("__row_h")
    values = values_in_order(df, column, key) if values is None else values
    placed, values = (d.repartition(pieces(df), "__place") for d in (placed, values))
    return placed.join(values, "__place").withColumn(column, F.col("__value")).select(*df.columns)


def advantage(base: float, context: float) -> float:
    """Improvement of context over base in percent."""
    return (base - context) / base * 100 if base else 0.0


def leakage_signal(out_of_fold: float, in_fold: float) -> float:
    """Percentage points by which improvement falls when statistics see their own rows: negative if leakage harms unseen rows."""
    return in_fold - out_of_fold


def permuted_target_passes(advantages: list[float], limit: float = 1.0) -> bool:
    return sum(advantages) / len(advantages) < limit


def shuffled_groups_passes(real: float, shuffled: float) -> bool:
    return real - shuffled > 0.5 * real


def promotion(diagnostics: dict[str, dict | None], needed: tuple[str, ...] = ("permuted_target", "shuffled_groups", "crossfit_ab", "feature_dominance")) -> dict:
    """Whether a run may be promoted: every diagnostic there and passed."""
    missing = [k for k in needed if not diagnostics.get(k)]
    failed = [k for k in needed if diagnostics.get(k) and not diagnostics[k].get("pass")]
    return {"promoted": not missing and not failed, "missing": missing, "failed": failed}
