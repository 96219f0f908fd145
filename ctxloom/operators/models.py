"""Regression models on Spark ML: factory, training, importances, feature search and pruning."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleanup import finite
from .guards import advantage
from .linalg import Moments, moments, moments_by
from .selection import select_significant, significant_of

# Presets by model; boosted and extra-tree families of other libraries map to the nearest Spark one.
PRESETS = {
    "gradient_boosting": {"maxIter": 40, "maxDepth": 4, "stepSize": 0.1},
    "random_forest": {"numTrees": 60, "maxDepth": 8},
    "extra_trees": {"numTrees": 60, "maxDepth": 8, "featureSubsetStrategy": "onethird", "subsamplingRate": 0.7},
    "ridge": {"regParam": 1.0},
    "ridge_cv": {},
    "linear": {},
}
ALIASES = {"xgboost": "gradient_boosting", "lightgbm": "gradient_boosting", "catboost": "gradient_boosting", "gbt": "gradient_boosting", "ridgecv": "ridge_cv"}
LABELS = {"gradient_boosting": "Gradient-boosted trees", "random_forest": "Random forest", "extra_trees": "Randomised trees", "ridge": "Ridge", "ridge_cv": "Ridge, cross-validated", "linear": "Least squares"}


def model_kind(name: str) -> str:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PRESETS:
        raise ValueError(f"unknown model {name!r}; known: {sorted([*PRESETS, *ALIASES])}")
    return key


def preset(name: str, overrides: dict | None = None) -> dict:
    return PRESETS[model_kind(name)] | (overrides or {})


def build_model(name: str, features: list[str], target: str, params: dict | None = None, seed: int = 42) -> Pipeline:
    """Impute by the median, assemble, scale for linear models, fit."""
    kind, own = model_kind(name), preset(name, params)
    filled = [f"{c}__f" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features_raw")]
    columns = {"featuresCol": "features_raw", "labelCol": target}
    if kind in ("ridge", "ridge_cv", "linear"):
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features_scaled", withMean=True))
        columns["featuresCol"] = "features_scaled"
        model = LinearRegression(elasticNetParam=0.0, **columns, **own)
        if kind == "ridge_cv":
            grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1, 1.0, 10.0]).build()
            model = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target), numFolds=3, seed=seed)
    elif kind == "gradient_boosting":
        model = GBTRegressor(seed=seed, **columns, **own)
    else:
        model = RandomForestRegressor(seed=seed, **columns, **own)
    return Pipeline(stages=[*stages, model])


@dataclass
class Scores:
    rmse: float
    mae: float
    r2: float
    n: int


@dataclass
class Trained:
    model: PipelineModel
    features: list[str]
    train: Scores
    test: Scores | None
    importances: dict[str, float]


def scores(predicted: DataFrame, target: str) -> Scores:
    """RMSE, MAE and R2 in one aggregation."""
    y, p = F.col(target).cast("double"), F.col("prediction")
    r = predicted.agg(F.count(F.lit(1)), F.avg(F.pow(p - y, 2)), F.avg(F.abs(p - y)), F.var_pop(y)).first()
    return Scores((r[1] or 0.0) ** 0.5, r[2] or 0.0, 1 - r[1] / r[3] if r[3] else 0.0, r[0])


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    last = model.stages[-1]
    last = getattr(last, "bestModel", last)
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
    total = float(sum(values)) or 1.0
    return {f: float(v) / total for f, v in zip(features, values, strict=True)}


def train_model(name: str, train: DataFrame, features: list[str], target: str, test: DataFrame | None = None, params: dict | None = None, seed: int = 42, drop_incomplete: bool = False) -> Trained:
    """Fit on train, score on both; infinite features are missing, missing ones are imputed unless their rows are dropped.

    A feature without any value in the training rows is left out; its importance is 0.
    """
    ready = lambda df: (lambda d: d.na.drop(subset=features) if drop_incomplete else d)(finite(df.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in [*features, target]]), features))
    rows = ready(train)
    counts = rows.agg(*[F.count(c).alias(c) for c in features]).first()
    usable = [c for c in features if counts[c]]
    if not usable:
        raise ValueError("no feature has a value in the training rows")
    fitted = build_model(name, usable, target, params, seed).fit(rows)
    weights = {c: 0.0 for c in features} | importances(fitted, usable)
    return Trained(fitted, usable, scores(fitted.transform(rows), target), scores(fitted.transform(ready(test)), target) if test is not None else None, weights)


def _with_target(df: DataFrame, features: list[str], target: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a target, infinite features as null; as train_model has them."""
    return finite(df.where(F.col(target).isNotNull()).select(*keep, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])]), features)


@dataclass
class Ridge:
    """The ridge model of train_model in closed form, over the features' own scale."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    importances: dict[str, float]

    def prediction(self) -> Column:
        return reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in zip(self.features, self.coefficients, strict=True)], F.lit(self.intercept))


def closed_form(name: str, params: dict | None) -> bool:
    """Whether a model with these settings is the ridge that moments give."""
    own = preset(name, params)
    return model_kind(name) == "ridge" and set(own) == {"regParam"} and own["regParam"] > 0


def fit_ridge(m: Moments, features: list[str], target: str, penalty: float) -> Ridge:
    """Spark's ridge: features and target are standardised, the penalty is divided by the target's deviation; flat features weigh 0."""
    at, y = [m.columns.index(c) for c in features], m.columns.index(target)
    cov = m.products / m.n
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    weights = np.zeros(len(features))
    if sd[y] > 0:
        safe = np.where(sd > 0, sd, np.inf)
        z = cov / np.outer(safe, safe)
        weights = np.linalg.solve(z[np.ix_(at, at)] + penalty / sd[y] * np.eye(len(at)), z[at, y])
        coefficients = weights * sd[y] / safe[at]
    else:
        coefficients = weights
    total = float(np.abs(weights).sum()) or 1.0
    return Ridge(features, [float(x) for x in coefficients], float(m.means[y] - coefficients @ m.means[at]), {f: abs(float(w)) / total for f, w in zip(features, weights, strict=True)})


def score_ridges(rows: DataFrame, models: list[Ridge], target: str) -> list[Scores] | None:
    """Scores of all models in one aggregation; None if a feature has gaps, which only a fitted imputer can fill."""
    used = list(dict.fromkeys(c for m in models for c in m.features))
    y = F.col(target)
    errors = [(F.avg(F.pow(m.prediction() - y, 2)), F.avg(F.abs(m.prediction() - y))) for m in models]
    r = _with_target(rows, used, target).agg(F.count(F.lit(1)), F.var_pop(y), *[e for pair in errors for e in pair], *[F.count(c) for c in used]).first()
    if any(v < r[0] for v in r[2 + 2 * len(models) :]):
        return None
    return [Scores((r[2 + 2 * k] or 0.0) ** 0.5, r[3 + 2 * k] or 0.0, 1 - r[2 + 2 * k] / r[1] if r[1] else 0.0, r[0]) for k in range(len(models))]


def ridge_sets(m: Moments, test: DataFrame, sets: list[list[str]], target: str, penalty: float) -> list[tuple[Ridge, Scores]] | None:
    """A ridge of every feature set and its scores on test; None where features have gaps."""
    used = [m.columns.index(c) for s in sets for c in s]
    if not m.n or any(m.values[k] < m.n for k in used):
        return None
    fitted = [fit_ridge(m, s, target, penalty) for s in sets]
    found = score_ridges(test, fitted, target)
    return found and list(zip(fitted, found, strict=True))


def ridge_rmse(m: Moments, ridge: Ridge, target: str) -> float:
    """The root mean squared error of a ridge on the rows of these moments, which have no gaps."""
    at, y = [m.columns.index(c) for c in ridge.features], m.columns.index(target)
    if not m.n:
        return 0.0
    w = np.zeros(len(m.columns))
    w[at], w[y] = ridge.coefficients, -1.0
    return math.sqrt(max(float(w @ m.products @ w) / m.n, 0.0) + (float(w @ m.means) + ridge.intercept) ** 2)


def median_fill(rows: DataFrame, features: list[str], target: str) -> Callable[[DataFrame], DataFrame]:
    """What fills gaps of features by the medians of rows, as the imputer of train_model does; each feature needs a value in rows."""
    found = Imputer(strategy="median", inputCols=features, outputCols=[f"{c}__f" for c in features]).fit(_with_target(rows, features, target)).surrogateDF.first()
    return lambda d: _with_target(d, features, target).select(*[F.coalesce(F.col(c), F.lit(found[c])).alias(c) for c in features], target)


@dataclass
class SearchResult:
    strategy: str
    features: list[str]
    validation_rmse: float
    seconds: float
    importances: dict[str, float] = field(default_factory=dict)


@dataclass
class SearchSummary:
    results: list[SearchResult]
    baseline: SearchResult
    best: SearchResult
    test: Scores | None

    def importance_rows(self) -> list[tuple[str, str, float]]:
        return [(f, r.strategy, v) for r in self.results for f, v in r.importances.items()]

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"baseline": asdict(self.baseline), "best": asdict(self.best), "test": self.test and asdict(self.test), "results": [asdict(r) for r in self.results]}, indent=1))


_SPLIT = ["train", "val"]


class FeatureSearch:
    """Tries feature sets on a validation split; the test rows are scored once, by the winner.

    Ridges come from the moments of the rows: a pass over the training rows and one
    over the validation rows, or one over both, serve any number of sets. Gaps are
    filled by the medians of the training rows before.
    """

    def __init__(self, base: list[str], context: list[str], target: str, model: str = "ridge", seed: int = 42, params: dict | None = None):
        self.base, self.context, self.target, self.model, self.seed, self.params = base, context, target, model, seed, params

    def draws(self) -> int:
        """Random sets drawn by default: a twentieth of all sets of context features, 50 to 500 of them, and no more than there are."""
        n = 2 ** len(self.context)
        return min(max(50, n // 20), 500, n)

    def combinations(self, n_random: int | None = None) -> list[tuple[str, list[str]]]:
        """Sets that need no data; of the random ones, repeated sets count once. A fifth as many (by default 10 or more) leave the base out."""
        n, alone = (self.draws(), max(10, self.draws() // 5)) if n_random is None else (n_random, n_random // 5)
        by_stat: dict[str, list[str]] = {}
        for c in self.context:
            by_stat.setdefault(c.rsplit("_", 1)[-1], []).append(c)
        out = [("baseline", self.base), ("all", [*self.base, *self.context]), ("context", self.context)]
        out += [(f"stat:{s}", [*self.base, *cs]) for s, cs in sorted(by_stat.items())]
        r = random.Random(self.seed)
        for name, base, times in (("random", self.base, n), ("context_random", [], alone)):
            if len(self.context) > 1:
                drawn = dict.fromkeys(tuple(sorted(r.sample(self.context, r.randint(1, len(self.context) - 1)))) for _ in range(times))
                out += [(f"{name}:{k}", [*base, *chosen]) for k, chosen in enumerate(drawn)]
        return [(n, f) for n, f in out if f]

    def ablations(self, importances: dict[str, float]) -> list[tuple[str, list[str]]]:
        """Sets without one context feature, without the most and the least important features of all, and of the most important alone."""
        both = [*self.base, *self.context]
        ranked = sorted(both, key=lambda c: (-importances[c], c))
        kept = [(f"without_best:{k}", ranked[k:]) for k in (1, 2, 3, 5, 10)] + [(f"without_worst:{k}", ranked[:-k]) for k in (1, 2, 3, 5, 10)]
        kept += [(f"best:{k}", ranked[:k]) for k in (3, 5, 10, 20)]
        out = [(f"without:{c}", [x for x in both if x != c]) for c in self.context]
        return [(n, f) for n, f in out + [(n, [c for c in both if c in f]) for n, f in kept if len(f) < len(both)] if f]

    def significant(self, select: Callable[[list[str], float], list[str]], importances: dict[str, float], limits: tuple[float, ...] = (0.01, 0.05), context_limit: float = 0.1) -> list[tuple[str, list[str]]]:
        """Sets of significant features, and of context that is significant or in the more important half by itself, with and without the base."""
        out = [(f"p<{x}", select([*self.base, *self.context], x)) for x in limits]
        if self.context:
            chosen = {f"context_p<{context_limit}": select(self.context, context_limit), "context_half": sorted(self.context, key=lambda c: (-importances[c], c))[: max(1, len(self.context) // 2)]}
            out += [s for name, f in chosen.items() if f for s in ((name, f), (f"base_{name}", [*self.base, *f]))]
        return [(n, f) for n, f in out if f]

    def sets(self, n_random: int | None, ablation: bool, significance: bool, rank: Callable[[list[str]], dict[str, float]], select: Callable[[list[str], float], list[str]]) -> list[tuple[str, list[str]]]:
        """All sets to try; rank gives importances of features by the search's own model, select those with a p-value below a limit."""
        out = self.combinations(n_random)
        if ablation:
            out += self.ablations(rank([*self.base, *self.context]))
        if significance:
            out += self.significant(select, rank(self.context) if self.context else {})
        return out

    def run(self, train: DataFrame, val: DataFrame, test: DataFrame | None = None, n_random: int | None = None, ablation: bool = False, significance: bool = False) -> SearchSummary:
        return self._run(train, val, test, n_random, ablation, significance)

    def run_split(self, rows: DataFrame, test: DataFrame | None = None, n_random: int | None = None, ablation: bool = False, significance: bool = False, split: str = "split") -> SearchSummary:
        """run() over rows that a column splits into train and val, which ridges read together."""
        train, val = (rows.where(F.col(split) == s) for s in _SPLIT)
        return self._run(train, val, test, n_random, ablation, significance, lambda used: moments_by(_with_target(rows, used, self.target, (split,)), split, _SPLIT, [*used, self.target]))

    def _run(self, train: DataFrame, val: DataFrame, test: DataFrame | None, n_random: int | None, ablation: bool, significance: bool, together: Callable[[list[str]], list[Moments]] | None = None) -> SearchSummary:
        needed = [*self.base, *self.context, self.target]
        train, val = (d.select(*dict.fromkeys(needed)) for d in (train, val))
        try:
            if closed_form(self.model, self.params) and (quick := self._by_moments(train, val, test, n_random, ablation, significance, together)):
                return quick
            train.persist()
            val.persist()
            fit = lambda f, side=None: train_model(self.model, train, f, self.target, side, self.params, self.seed)
            values = _with_target(train, needed[:-1], self.target).agg(*[F.count(c).alias(c) for c in dict.fromkeys(needed[:-1])]).first()
            usable = lambda f: [c for c in f if values[c]]
            rank = lambda f: fit(f).importances if usable(f) else dict.fromkeys(f, 0.0)
            results = []
            for name, features in self.sets(n_random, ablation, significance, rank, lambda f, x: select_significant(train, usable(f), self.target, x)):
                if results and not usable(features):
                    continue
                began = time.time()
                t = fit(features, val)
                results.append(SearchResult(name, features, t.test.rmse, time.time() - began, t.importances))
            best = min(results, key=lambda x: (x.validation_rmse, len(x.features)))
            final = train_model(self.model, train.unionByName(val), best.features, self.target, test, self.params, self.seed).test if test is not None else None
        finally:
            train.unpersist()
            val.unpersist()
        return SearchSummary(results, results[0], best, final)

    def _by_moments(self, train: DataFrame, val: DataFrame, test: DataFrame | None, n_random: int | None, ablation: bool, significance: bool, together: Callable[[list[str]], list[Moments]] | None) -> SearchSummary | None:
        """The same search by moments; None where train_model would have nothing to fit."""
        began = time.time()
        penalty, used = preset(self.model, self.params)["regParam"], [*dict.fromkeys([*self.base, *self.context])]
        of = lambda d: moments(_with_target(d, used, self.target), [*used, self.target])
        m, v = together(used) if together else (of(train), of(val))
        known = {c for c, n in zip(m.columns, m.values, strict=True) if n} - {self.target}
        if not known.intersection(self.base or used):
            return None
        usable = lambda f: [c for c in f if c in known]
        gaps = [*m.values, *v.values] != [m.n] * len(m.values) + [v.n] * len(v.values)
        whole = m + v
        if gaps:
            train.persist()
            val.persist()
            fill = median_fill(train, usable(used), self.target)
            m, v = (moments(fill(d), [*usable(used), self.target]) for d in (train, val))
        fit = lambda f: (lambda r: replace(r, importances=dict.fromkeys(f, 0.0) | r.importances))(fit_ridge(m, usable(f), self.target, penalty))
        sets = self.sets(n_random, ablation, significance, lambda f: fit(f).importances, lambda f, x: significant_of(m, usable(f), self.target, x))
        found = [(name, f, fit(f)) for name, f in sets if usable(f)]
        each = (time.time() - began) / len(found)
        results = [SearchResult(name, f, ridge_rmse(v, ridge, self.target), each, ridge.importances) for name, f, ridge in found]
        best = min(results, key=lambda x: (x.validation_rmse, len(x.features)))
        final = None
        if test is not None:
            last = None if gaps else ridge_sets(whole, test, [best.features], self.target, penalty)
            if not last:
                both = train.unionByName(val)
                known |= {c for c, n in zip(whole.columns, whole.values, strict=True) if n} - {self.target}
                fill = median_fill(both, usable(best.features), self.target)
                last = ridge_sets(moments(fill(both), [*usable(best.features), self.target]), fill(test), [usable(best.features)], self.target, penalty)
            final = last[0][1]
        return SearchSummary(results, results[0], best, final)


def iterative_pruning(train: DataFrame, val: DataFrame, features: list[str], target: str, model: str = "random_forest", keep: float = 0.7, smallest: int = 2, params: dict | None = None) -> list[SearchResult]:
    """Retrains on the most important share of features until few are left."""
    out, current = [], list(features)
    while True:
        t = train_model(model, train, current, target, val, params)
        out.append(SearchResult(f"top {len(current)}", current, t.test.rmse, 0.0, t.importances))
        n = max(smallest, int(len(current) * keep))
        if n >= len(current):
            return out
        current = sorted(current, key=lambda c: (-t.importances[c], c))[:n]


@dataclass
class Leg:
    base: Scores
    context: Scores

    @property
    def improvement(self) -> float:
        return advantage(self.base.rmse, self.context.rmse)


def legs(model: str, train: DataFrame, test: DataFrame, base: list[str], contexts: list[list[str]], target: str, params: dict | None = None) -> list[Leg]:
    """The same model without and with each set of context features; ridges of gapless features take a pass over each side for all sets."""
    needed = list(dict.fromkeys([*base, *(c for context in contexts for c in context), target]))
    sets = [base, *([*base, *context] for context in contexts)]
    if closed_form(model, params):
        m = moments(_with_target(train, needed[:-1], target), needed)
        found = ridge_sets(m, test, sets, target, preset(model, params)["regParam"])
        if found:
            return [Leg(found[0][1], x[1]) for x in found[1:]]
    train, test = train.select(*needed).persist(), test.select(*needed).persist()
    try:
        first, *others = [train_model(model, train, s, target, test, params).test for s in sets]
        return [Leg(first, x) for x in others]
    finally:
        train.unpersist()
        test.unpersist()


def two_legs(model: str, train: DataFrame, test: DataFrame, base: list[str], context: list[str], target: str, params: dict | None = None) -> Leg:
    """The same model without and with context features."""
    return legs(model, train, test, base, [context], target, params)[0]


def grid(configs: dict[str, list]) -> list[dict]:
    """All combinations of settings."""
    return [dict(zip(configs, values, strict=True)) for values in itertools.product(*configs.values())]
