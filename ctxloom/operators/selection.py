"""Linear-model statistics of features and selection by them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .linalg import Moments, gram, t_two_sided
from .prepare import fill_median


@dataclass
class FeatureStatistics:
    feature: str
    coefficient: float
    std_error: float
    t_value: float
    p_value: float
    r_squared: float  # of the whole model
    pearson_r: float
    pearson_p: float


@dataclass
class LinearStatistics:
    features: list[FeatureStatistics]
    n: int

    def p_values(self) -> dict[str, float]:
        return {s.feature: s.p_value for s in self.features}


def _solve(z: np.ndarray, n: int, names: list[str]) -> list[FeatureStatistics]:
    """Least squares from the correlation matrix z, whose last row is the target: coefficients are standardised."""
    k = len(names)
    own, target = z[:k, :k], z[:k, k]
    inverse = np.linalg.pinv(own)
    beta = inverse @ target
    r2 = float(min(max(beta @ target, 0.0), 1.0))
    dof = n - k - 1
    out = []
    for j, name in enumerate(names):
        error = math.sqrt(max((1 - r2) / dof * inverse[j, j], 0.0)) if dof > 0 else math.nan
        t = beta[j] / error if error else math.nan
        r = float(target[j])
        rt = r * math.sqrt((n - 2) / (1 - r * r)) if n > 2 and abs(r) < 1 else math.inf
        out.append(FeatureStatistics(name, float(beta[j]), error, float(t), t_two_sided(t, dof), r2, r, 0.0 if math.isinf(rt) else t_two_sided(rt, n - 2)))
    return out


def _standardised(df: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, int]:
    """Correlation matrix of features and target, from one pass; the Gram matrix is centred on the driver."""
    filled = fill_median(df.where(df[target].isNotNull()), features)
    g, sums, n = gram(filled, [*features, target])
    if not n:
        raise ValueError("no rows with a target")
    return _correlation(g / n - np.outer(sums / n, sums / n)), n


def _correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = np.inf
    return cov / np.outer(sd, sd)


def lm_statistics(df: DataFrame, features: list[str], target: str) -> LinearStatistics:
    """Standardised coefficients with errors, t and p values, model R2, and Pearson correlations; missing features are filled by the median."""
    z, n = _standardised(df, features, target)
    return LinearStatistics(_solve(z, n, features), n)


def select_significant(df: DataFrame, features: list[str], target: str, limit: float = 0.05, backward: bool = False) -> list[str]:
    """Features whose p-value is below limit; backward: drop the worst until all are. The data is read once."""
    return _significant(*_standardised(df, features, target), features, limit, backward)


def significant_of(m: Moments, features: list[str], target: str, limit: float = 0.05, backward: bool = False) -> list[str]:
    """select_significant by the moments of rows without gaps."""
    at = [m.columns.index(c) for c in [*features, target]]
    return _significant(_correlation(m.products[np.ix_(at, at)] / m.n), m.n, features, limit, backward)


def _significant(z: np.ndarray, n: int, features: list[str], limit: float, backward: bool) -> list[str]:
    index = list(range(len(features)))
    while index:
        rows = [*index, len(features)]
        stats = _solve(z[np.ix_(rows, rows)], n, [features[k] for k in index])
        if not backward:
            return [s.feature for s in stats if s.p_value < limit]
        worst = max(range(len(index)), key=lambda k: (math.inf if math.isnan(stats[k].p_value) else stats[k].p_value))
        if stats[worst].p_value < limit:
            break
        del index[worst]
    return [features[k] for k in index]


@dataclass
class SignificanceSelector:
    """Keeps significant features: fit once, transform anything with those columns."""

    features: list[str]
    target: str
    limit: float = 0.05
    backward: bool = False
    chosen: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> SignificanceSelector:
        self.chosen = select_significant(df, self.features, self.target, self.limit, self.backward)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.features if c not in self.chosen])
