"""The context engine: statistics joined back to rows, out-of-fold for training rows.

Estimator and Model: fit() computes the store of statistics, transform() joins
it to other rows, fit_transform() gives the training rows statistics that never
saw their own fold.

Random folds average the other folds' statistics (counts are added); time and
rolling folds pool the training window before each fold.  Rows outside every
validation block have null context.  Statistics are joined by equality that
matches null keys; the joins carry no broadcast hint, so Spark decides by size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON, ContextSpec
from ..functions.relative import relative_features
from .backoff import apply_backoff, column, fallback_chain
from .cleanup import Cleanup
from .folds import balanced_fold, positions, side, time_bounds
from .levels import Level, cardinalities, detect_keys, global_stats, level_name, level_stats, make_levels


def resolve_keys(df: DataFrame, spec: ContextSpec) -> ContextSpec:
    """spec with keys detected if none are given; at least min_keys are needed."""
    keys = spec.keys if spec.keys is not None else tuple(detect_keys(df, (spec.target, *spec.exclude), spec.max_cardinality))
    if missing := [c for c in (*keys, spec.target) if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    if len(keys) < spec.min_keys:
        raise ValueError(f"{len(keys)} keys found, {spec.min_keys} needed")
    return spec.with_keys(keys)


def spec_levels(spec: ContextSpec) -> list[Level]:
    return make_levels(spec.keys, spec.interactions, spec.depth, spec.allowed_interactions)


def stats_of(df: DataFrame, level: Level, spec: ContextSpec, fold: str | None = None) -> DataFrame:
    """A level's statistics, of each fold alone if fold is given; size limits hold within a fold.

    Order statistics of groups too large to be held in one task are computed by
    ranges, unless the settings say otherwise for keyed levels.
    """
    extra = (fold,) if fold else ()
    if level:
        return level_stats(df, level, spec.target, spec.stats, spec.min_group_size, extra, spec.quantiles)
    return global_stats(df, spec.target, spec.stats, extra, "refined" if spec.quantiles == "refined" else "auto")


def combined_folds(per_fold: DataFrame, level: Level, spec: ContextSpec, fold: str, folds: list[int] | None, variance: bool) -> DataFrame:
    """Other folds' statistics for every fold (folds given), or all folds' (None): unweighted means, added counts, spread.

    Every fold's row is offered to each other fold, so the rows grow n_folds-fold
    and one group-by does the rest.
    """
    if folds is not None:
        others = F.explode(F.array_except(F.array(*map(F.lit, folds)), F.array(F.col("__from").cast("int")))).alias("__to")
        per_fold = per_fold.withColumnRenamed(fold, "__from").select(others, *level, *spec.stats, F.col("__from"))
        by = ["__to", *level]
    else:
        by = list(level)
    aggs = []
    for s in spec.stats:
        if s == "count":
            aggs.append(F.sum(s).alias(s))
            continue
        aggs.append(F.avg(s).alias(s))
        if variance and spec.fold_variance:
            # one fold has no spread: 0 for groups, null for all rows
            spread = F.stddev_samp(s) if not level else F.when(F.count(s) > 0, F.coalesce(F.stddev_samp(s), F.lit(0.0)))
            wanted = {"std": spread, "cv": F.try_divide(spread, F.abs(F.avg(s)) + F.lit(EPSILON)), "lower": F.avg(s) - 2 * spread, "upper": F.avg(s) + 2 * spread}
            aggs += [wanted[f].alias(f"{s}_fold_{f}") for f in spec.fold_features]
    out = per_fold.groupBy(*by).agg(*aggs)
    return out.withColumnRenamed("__to", fold) if folds is not None else out


def join_level(df: DataFrame, stats: DataFrame, level: Level, target: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Left join of a level's statistics under prefixed names; null keys match null keys."""
    by = [*extra, *level]
    named = stats.select(*[F.col(k).alias(f"__k_{k}") for k in by], *[F.col(c).alias(column(level, target, c)) for c in stats.columns if c not in by])
    if not by:
        return df.join(F.broadcast(named.limit(1)), F.lit(True), "left")  # one row, or none without targets
    if not level:
        named = F.broadcast(named)  # one row per fold
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
    return df.join(named, condition, "left").drop(*[f"__k_{k}" for k in by])


def serving(spec: ContextSpec, columns: list[str]) -> ContextSpec:
    """spec without what these context columns do not come from, which keep their values.

    Left out are combinations of keys that are neither theirs nor their fallbacks',
    and, where nothing else reads them, statistics and fold spreads; the count stays,
    as size limits are held against it.
    """
    combined = [x for x in spec_levels(spec) if len(x) > 1]
    wanted = [set(x) for x in combined if any(c.startswith(f"{level_name(x)}_{spec.target}_") for c in columns)]
    spec = replace(spec, allowed_interactions=tuple(x for x in combined if any(set(x) <= w for w in wanted)))
    if spec.relative or spec.cleanup or spec.backoff_depth:
        return spec
    read = [s for s in spec.stats if any(c.endswith(f"_{spec.target}_{s}") or f"_{spec.target}_{s}_fold_" in c for c in columns)]
    spreads = tuple(f for f in spec.fold_features if any(c.endswith(f"_fold_{f}") for c in columns))
    return replace(spec, stats=tuple(s for s in spec.stats if s in read or s == "count") if read else spec.stats, fold_features=spreads)


def _cardinality(df: DataFrame, spec: ContextSpec) -> dict[str, int]:
    """Cardinalities of the keys, counted only where a combination's fallbacks are ordered by them."""
    return cardinalities(df, spec.keys) if any(len(x) > 1 for x in spec_levels(spec)) else {}


def _all_levels(spec: ContextSpec) -> list[Level]:
    return [*([()] if spec.global_stats else []), *spec_levels(spec)]


def _finished(df: DataFrame, spec: ContextSpec, cardinality: dict[str, int]) -> DataFrame:
    """Backoff and relative features over joined statistics."""
    levels = spec_levels(spec)
    out = apply_backoff(df, levels, spec.target, spec.stats, cardinality, spec.backoff_depth, spec.global_stats)
    if spec.relative:
        if spec.target not in df.columns:
            raise ValueError("relative features need the target")
        out = relative_features(out, [level_name(x) for x in levels], spec.target)
    return out


@dataclass
class ContextModel:
    """A fitted store of statistics by level."""

    spec: ContextSpec
    store: dict[Level, DataFrame]
    cleanup: Cleanup | None = None
    cardinality: dict[str, int] | None = None  # None: that of the rows being transformed

    def transform(self, df: DataFrame, finish: bool = True) -> DataFrame:
        if missing := [k for k in self.spec.keys if k not in df.columns]:
            raise ValueError(f"missing columns {missing}")
        out = df
        for level in _all_levels(self.spec):
            out = join_level(out, self.store[level], level, self.spec.target)
        out = _finished(out, self.spec, self.cardinality or _cardinality(df, self.spec))
        if self.spec.cleanup and finish:
            if self.cleanup is None:
                if self.spec.target not in df.columns:
                    raise ValueError("the first transform with cleanup needs the target")
                self.cleanup = Cleanup(self.spec.cleanup, self.spec.target, self.spec.keys).fit(out)
            out = self.cleanup.transform(out)
        return out


class ContextEstimator:
    def __init__(self, spec: ContextSpec, row_key: tuple[str, ...] = (), fold_of: Callable[[DataFrame], DataFrame] | None = None):
        """row_key orders rows for random folds; fold_of may add its own `fold` column instead."""
        self.spec, self.row_key, self.fold_of = spec, row_key, fold_of

    def fit(self, df: DataFrame) -> ContextModel:
        """Statistics of all rows."""
        spec = resolve_keys(df, self.spec)
        return ContextModel(spec, {x: stats_of(df, x, spec) for x in _all_levels(spec)})

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, ContextModel]:
        """Out-of-fold context of the rows, and the model for later rows."""
        spec = resolve_keys(df, self.spec)
        if spec.strategy == "off":
            model = ContextEstimator(spec).fit(df)
            out = model.transform(df)
            return out, model
        out, model = self._random(df, spec) if spec.strategy == "random" else self._in_time(df, spec)
        if spec.cleanup:
            model.cleanup = Cleanup(spec.cleanup, spec.target, spec.keys).fit(out)
            out = model.cleanup.transform(out)
        return out, model

    def _random(self, df: DataFrame, spec: ContextSpec) -> tuple[DataFrame, ContextModel]:
        own = self.fold_of is None
        folded = balanced_fold(df, list(self.row_key or df.columns), spec.n_folds, spec.seed, "__fold") if own else self.fold_of(df).withColumnRenamed("fold", "__fold")
        per_fold = {x: stats_of(folded, x, spec, "__fold") for x in _all_levels(spec)}
        out = folded
        for level, stats in per_fold.items():
            out = join_level(out, combined_folds(stats, level, spec, "__fold", list(range(spec.n_folds)), True), level, spec.target, ("__fold",))
        out = _finished(out, spec, _cardinality(df, spec)).drop("__fold")
        if spec.pooled_store or not spec.fold_variance:
            return out, ContextEstimator(spec).fit(df)
        return out, ContextModel(spec, {x: combined_folds(s, x, spec, "__fold", None, True) for x, s in per_fold.items()})

    def _in_time(self, df: DataFrame, spec: ContextSpec) -> tuple[DataFrame, ContextModel]:
        """All folds in one pass: each row goes to every training window that holds it, statistics carry their fold."""
        placed = positions(df, [spec.time_col, *spec.tie_cols], "__pos")
        bounds = time_bounds(df.count(), spec.n_folds, spec.test_size, spec.gap, spec.max_train_size, spec.strategy == "rolling")
        pos = F.col("__pos")
        windows = F.filter(F.array(*[F.when(side(pos, b, "train"), F.lit(b["fold"])) for b in bounds]), lambda k: k.isNotNull())
        train = placed.select(*dict.fromkeys([*spec.keys, spec.target]), F.explode(windows).alias("__fold"))
        rows = placed.withColumn("__fold", F.coalesce(*[F.when(side(pos, b, "val"), F.lit(b["fold"])) for b in bounds])).drop("__pos")
        out = rows
        for level in _all_levels(spec):
            out = join_level(out, stats_of(train, level, spec, "__fold"), level, spec.target, ("__fold",))
        parts = [_finished(out if folds is None else out.where(F.col("__fold").isin(folds) if folds else F.col("__fold").isNull()), spec, cardinality) for folds, cardinality in _fold_groups(rows, spec)]
        whole = reduce(DataFrame.unionByName, parts)
        # rows in no validation block stay blank
        held = [c if c in df.columns else F.when(F.col("__fold").isNotNull(), F.col(f"`{c}`")).alias(c) for c in whole.columns if c != "__fold"]
        return whole.select(*held), ContextEstimator(spec).fit(df)


def _fold_groups(rows: DataFrame, spec: ContextSpec) -> list[tuple[list[int] | None, dict[str, int]]]:
    """Folds whose keys' cardinalities give the same fallback chains, with these cardinalities; None: all rows alike."""
    if not spec.keys:
        return [(None, {})]
    levels = spec_levels(spec)
    counts = [(F.count_distinct(F.col(k)) + F.max(F.col(k).isNull().cast("int"))).alias(k) for k in spec.keys]
    groups: dict[tuple, tuple[list[int], dict[str, int]]] = {}
    for row in rows.where("__fold IS NOT NULL").groupBy("__fold").agg(*counts).collect():  # one row per fold
        cardinality = {k: row[k] for k in spec.keys}
        chains = tuple(tuple(fallback_chain(x, cardinality, set(levels))) for x in levels)
        groups.setdefault(chains, ([], cardinality))[0].append(row["__fold"])
    if len(groups) <= 1:
        return [(None, next(iter(groups.values()))[1] if groups else dict.fromkeys(spec.keys, 0))]
    found = list(groups.values())
    return [*found, ([], found[0][1])]


def time_fold_audit(df: DataFrame, spec: ContextSpec) -> DataFrame:
    """Sizes and time bounds of each fold's training window and validation block."""
    placed = positions(df, [spec.time_col, *spec.tie_cols], "__pos")
    bounds = time_bounds(df.count(), spec.n_folds, spec.test_size, spec.gap, spec.max_train_size, spec.strategy == "rolling")
    t, pos = F.col(spec.time_col), F.col("__pos")
    found = []
    for b in bounds:
        tr, va = side(pos, b, "train"), side(pos, b, "val")
        found.append(F.struct(F.lit(b["fold"]).alias("fold"), F.count_if(tr).alias("train_size"), F.count_if(va).alias("val_size"), F.max(F.when(tr, t)).alias("train_max"), F.min(F.when(va, t)).alias("val_min"), F.max(F.when(va, t)).alias("val_max")))
    return placed.agg(F.array(*found).alias("folds")).select(F.inline("folds"))
