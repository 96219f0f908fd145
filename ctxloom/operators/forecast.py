"""Walk-forward forecasting: sector, residual and quantile heads, folds, assembled predictions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WalkForwardSpec
from ..functions.aggregates import quantiles_of
from ..functions.windows import forward_targets, panel
from .folds import period_rank, side, time_bounds, walk_forward_folds
from .guards import design_columns, fold_violations
from .lineage import cut
from .metrics import accuracy, across_folds, comparison, long_short, portfolio, select_horizon
from .models import Trained, train_model


@dataclass
class HeadModels:
    sector: dict[int, Trained] = field(default_factory=dict)
    residual: dict[int, Trained] = field(default_factory=dict)
    fill: dict[int, float] = field(default_factory=dict)  # mean held-out sector forecast
    spread: dict[int, dict[float, float]] = field(default_factory=dict)  # quantiles of held-out errors


def _params(spec: WalkForwardSpec) -> dict:
    return {"maxIter": spec.trees, "maxDepth": spec.depth, "stepSize": spec.rate}


def sector_rows(df: DataFrame, features: list[str], label: str, sector: str, ts: str, *more: str) -> DataFrame:
    """Sector means of features and label per time."""
    return df.groupBy(sector, ts, *more).agg(*[F.avg(c).alias(c) for c in features], F.avg(label).alias(label))


def _scored(t: Trained, df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in t.features if c not in keep])
    return t.model.transform(rows).select(*keep, F.col("prediction").alias(name))


def _held_out(model: str, ranked: DataFrame, features: list[str], label: str, params: dict | None, keep: list[str], n_folds: int, gap: int) -> DataFrame:
    """keep and __p: forecasts of rows (with __period) by models that saw only earlier periods, the gap left out; rows before the first block have none."""
    low, high = ranked.agg(F.min("__period"), F.max("__period")).first()
    at = F.col("__period") - F.lit(low)
    parts = []
    for b in time_bounds(0 if low is None else high - low + 1, n_folds, gap=gap, rolling=True):
        fitted = train_model(model, ranked.where(side(at, b, "train")), features, label, params=params)
        parts.append(_scored(fitted, ranked.where(side(at, b, "val")), "__p", keep))
    return cut(reduce(DataFrame.unionByName, parts))


def fit_heads(train: DataFrame, features: list[str], spec: WalkForwardSpec, sector: str = "sector", ts: str = "period_close_ts", model: str = "gradient_boosting") -> HeadModels:
    """Per horizon: sector means are forecast first, then what they leave of each instrument, then the spread.

    The residual head learns from sector forecasts that were held out in rolling
    folds over the training periods, and the spread is that of its own held-out
    errors; labels that reach into a held-out block are left out of its training
    window.  Too few periods for that raise ValueError.
    """
    out = HeadModels()
    params = _params(spec) if model == "gradient_boosting" else None
    for h in spec.horizons:
        label = f"ret_h{h}"
        rows = cut(period_rank(train.where(F.col(label).isNotNull()), ts))
        sectors = cut(sector_rows(rows, features, label, sector, ts, "__period"))
        out.sector[h] = train_model(model, sectors, features, label, params=params)
        forecast = _held_out(model, sectors, features, label, params, [sector, ts], spec.oof_folds, h)
        out.fill[h] = forecast.agg(F.avg("__p")).first()[0] or 0.0
        rest = cut(rows.join(forecast, [sector, ts]).withColumn("__rest", F.col(label) - F.col("__p")).drop("__p"))
        out.residual[h] = train_model(model, rest, features, "__rest", params=params)
        errors = _held_out(model, rest, features, "__rest", params, ["__rest"], spec.oof_folds, h).select((F.col("__rest") - F.col("__p")).alias("e"))
        q = quantiles_of(errors, [], "e", tuple(spec.quantiles)).first()
        out.spread[h] = dict(zip(spec.quantiles, q["__p"] if q else [0.0] * len(spec.quantiles), strict=True))
    return out


def predict_heads(heads: HeadModels, df: DataFrame, features: list[str], spec: WalkForwardSpec, key: list[str], sector: str = "sector", ts: str = "period_close_ts") -> DataFrame:
    """key, sector and rest forecasts, their sum, and its quantiles: the mean forecast shifted by residual quantiles."""
    out = df.select(*key, sector)
    for h in spec.horizons:
        means = df.groupBy(sector, ts).agg(*[F.avg(c).alias(c) for c in features])
        s = _scored(heads.sector[h], means, f"pred_sector_h{h}", [sector, ts])
        i = _scored(heads.residual[h], df, f"pred_resid_h{h}", key)
        out = out.join(i, key, "left").join(s, [*[c for c in (sector, ts) if c in out.columns]], "left")
        total = F.coalesce(F.col(f"pred_sector_h{h}"), F.lit(heads.fill[h])) + F.col(f"pred_resid_h{h}")
        out = out.withColumn(f"pred_h{h}", total)
        out = out.select("*", *[(F.col(f"pred_h{h}") + F.lit(v)).alias(f"pred_h{h}_q{round(100 * q):02d}") for q, v in heads.spread[h].items()])
    return out


@dataclass
class WalkForwardResult:
    predictions: DataFrame
    folds: DataFrame
    accuracy: DataFrame
    portfolio: DataFrame
    horizon: int | None
    metadata: dict


def run_walk_forward(features: DataFrame, spec: WalkForwardSpec, key: str = "ticker", ts: str = "period_close_ts", close: str = "close", sector: str = "sector", model: str = "gradient_boosting", enrich=None) -> WalkForwardResult:
    """Labels, folds, a monotonicity gate, then per fold: enrich on train, fit heads, predict validation and test.

    Labels join after enrichment. The horizon is chosen on validation rows, accuracy is that of test rows.
    """
    labels = features.select(key, ts, *forward_targets(close, panel(key, ts), spec.horizons))
    folds = walk_forward_folds(features, ts, spec.train, spec.val, spec.test, spec.step)
    if not fold_violations(folds).isEmpty():
        raise ValueError("folds overlap or do not advance")
    ordered = folds.orderBy("fold_idx")
    bounds = (ordered.limit(spec.max_folds) if spec.max_folds else ordered).collect()  # one row per fold
    parts = []
    for b in bounds:
        cut = lambda lo, hi: features.where(F.col(ts).between(F.lit(lo), F.lit(hi)))
        sides = {"train": cut(b.train_start, b.train_max), "val": cut(b.val_min, b.val_max), "test": cut(b.test_min, b.test_max)}
        if enrich is not None:
            sides = enrich(sides)
        names = design_columns(sides["train"], (close, key, ts, sector))
        heads = fit_heads(sides["train"].join(labels, [key, ts], "left"), names, spec, sector, ts, model)
        for side in ("val", "test"):
            predicted = predict_heads(heads, sides[side], names, spec, [key, ts], sector, ts)
            parts.append(predicted.join(labels, [key, ts], "left").select(F.lit(b.fold_idx).alias("fold_idx"), F.lit(side).alias("split"), "*"))
    predictions = reduce(DataFrame.unionByName, parts)
    return summarise(predictions, folds, spec, key, ts)


def summarise(predictions: DataFrame, folds: DataFrame, spec: WalkForwardSpec, key: str, ts: str) -> WalkForwardResult:
    long = reduce(DataFrame.unionByName, [predictions.select("fold_idx", "split", key, ts, F.lit(h).alias("horizon"), F.col(f"ret_h{h}").alias("ret"), F.col(f"pred_h{h}").alias("pred")) for h in spec.horizons])
    per_fold = accuracy(long.where("split = 'test'"), "ret", "pred", ["horizon", "fold_idx"])
    ls = long_short(long.where("split = 'val'"), ts, "pred", "ret", key, by=("horizon",))
    held = portfolio(ls, ["horizon"])
    best = select_horizon(held, "sharpe").first()
    meta = {"config": spec.metadata(), "config_hash": hashlib.sha256(json.dumps(spec.metadata(), sort_keys=True).encode()).hexdigest()[:16]}
    return WalkForwardResult(predictions, folds, across_folds(per_fold, ["horizon"]), held, best and best.horizon, meta)


def partial_enrichment(estimator, ts: str):
    """An enrich function: context fitted on the training block, joined to all three."""

    def enrich(sides: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out, model = estimator.fit_transform(sides["train"])
        return {"train": out, "val": model.transform(sides["val"]), "test": model.transform(sides["test"])}

    return enrich


def ranked_periods(df: DataFrame, ts: str) -> DataFrame:
    return period_rank(df, ts, "period")


def run_baseline_vs_context(features: DataFrame, spec: WalkForwardSpec, enrich, **more) -> tuple[WalkForwardResult, WalkForwardResult, DataFrame]:
    """The same walk-forward without and with enrichment, and test accuracy side by side per horizon and fold."""
    plain, rich = run_walk_forward(features, spec, **more), run_walk_forward(features, spec, enrich=enrich, **more)

    def per_fold(result: WalkForwardResult) -> DataFrame:
        test = result.predictions.where("split = 'test'")
        long = reduce(DataFrame.unionByName, [test.select("fold_idx", F.lit(h).alias("horizon"), F.col(f"ret_h{h}").alias("ret"), F.col(f"pred_h{h}").alias("pred")) for h in spec.horizons])
        return accuracy(long, "ret", "pred", ["horizon", "fold_idx"])

    return plain, rich, comparison(per_fold(plain), per_fold(rich), ["horizon", "fold_idx"])
