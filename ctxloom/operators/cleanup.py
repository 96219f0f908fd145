"""Feature cleanup, fitted once and replayed as a drop list."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleanupSpec
from ..functions.aggregates import STATS
from .linalg import correlation_matrix, correlations, gram


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and NaN values as null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def parse_feature(name: str, target: str) -> tuple[tuple[str, ...], str] | None:
    """(level columns, statistic) of a context column name, or None."""
    for s in sorted(STATS, key=len, reverse=True):
        if name.endswith(f"_{target}_{s}"):
            level = name[: -len(f"_{target}_{s}")]
            return (() if level == "global" else tuple(level.split("__"))), s
    return None


@dataclass
class Cleanup:
    spec: CleanupSpec
    target: str
    keep: tuple[str, ...] = ()
    dropped: dict[str, list[str]] = field(default_factory=dict)  # reason -> columns
    warned: list[str] = field(default_factory=list)
    seen: int = 0

    @property
    def drop_list(self) -> list[str]:
        return [c for cs in self.dropped.values() for c in cs]

    @property
    def removal_rate(self) -> float:
        return len(self.drop_list) / self.seen if self.seen else 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.drop_list)

    def fit(self, df: DataFrame) -> Cleanup:
        features = numeric_columns(df, (self.target, *self.keep))
        self.seen = len(features)
        df = finite(df.select(*features, self.target), [*features, self.target]).persist()
        try:
            features = self._constant(df, features)
            with_target = {c: abs(v) if v is not None else 0.0 for (c, _), v in correlations(df, features, [self.target]).items()}
            features = self._leaky(features, with_target)
            features = self._correlated(df, features, with_target)
            if self.spec.use_vif:
                features = self._inflated(df, features)
            if self.spec.use_hierarchy:
                self._hierarchical(df, features)
        finally:
            df.unpersist()
        return self

    def _drop(self, reason: str, columns: list[str], features: list[str]) -> list[str]:
        self.dropped[reason] = columns
        return [c for c in features if c not in set(columns)]

    def _constant(self, df: DataFrame, features: list[str]) -> list[str]:
        if not features:
            return features
        self.variance = df.agg(*[F.var_samp(c).alias(c) for c in features]).first().asDict()
        return self._drop("constant", [c for c in features if self.variance[c] is not None and self.variance[c] < self.spec.min_variance], features)

    def _leaky(self, features: list[str], with_target: dict[str, float]) -> list[str]:
        self.warned = [c for c in features if self.spec.leakage_warn < with_target[c] <= self.spec.leakage_drop]
        return self._drop("leakage", [c for c in features if with_target[c] > self.spec.leakage_drop], features)

    def _correlated(self, df: DataFrame, features: list[str], with_target: dict[str, float]) -> list[str]:
        """Greedy removal: dropping a column leaves all other correlations as they are, so one matrix serves."""
        matrix = np.abs(correlation_matrix(df, features, self.spec.method))
        pairs = [(-matrix[i, j], i, j) for i in range(len(features)) for j in range(i + 1, len(features)) if matrix[i, j] > self.spec.correlation]
        gone: set[int] = set()
        for _, i, j in sorted(pairs):
            if i not in gone and j not in gone:
                gone.add(i if self._worse(features[i], features[j], with_target) else j)
        return self._drop("correlated", [c for k, c in enumerate(features) if k in gone], features)

    def _worse(self, a: str, b: str, with_target: dict[str, float]) -> bool:
        """Whether a goes rather than b; ties drop b."""
        if self.spec.strategy == "lower_target_corr":
            return with_target[a] < with_target[b]
        if self.spec.strategy == "lower_variance":
            return (self.variance[a] or 0) < (self.variance[b] or 0)
        if self.spec.strategy == "hierarchy":
            pa, pb = parse_feature(a, self.target), parse_feature(b, self.target)
            return (len(pa[0]) if pa else 0) < (len(pb[0]) if pb else 0)
        return False

    def _inflated(self, df: DataFrame, features: list[str]) -> list[str]:
        """Variance inflation without intercept: G_jj * inv(G)_jj of the Gram matrix, worst first."""
        if len(features) < 2:
            return features
        whole, _, _ = gram(df.na.drop(subset=features), features)
        index = list(range(len(features)))
        while len(index) > 1:
            own = whole[np.ix_(index, index)]
            vif = np.diag(own) * np.diag(np.linalg.pinv(own))
            if vif.max() <= self.spec.max_vif:
                break
            del index[int(vif.argmax())]
        return self._drop("vif", [c for k, c in enumerate(features) if k not in index], features)

    def _hierarchical(self, df: DataFrame, features: list[str]) -> list[str]:
        """Same statistic on nested levels that say the same: one of the two goes."""
        parsed = {c: p for c in features if (p := parse_feature(c, self.target))}
        pairs = [(a, b) for a in parsed for b in parsed if parsed[a][1] == parsed[b][1] and set(parsed[a][0]) < set(parsed[b][0])]
        found = {} if not pairs else df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
        gone: list[str] = []
        for k, (parent, child) in enumerate(pairs):
            r = found[k]
            if r is not None and not math.isnan(r) and abs(r) >= self.spec.hierarchy_correlation and parent not in gone and child not in gone:
                gone.append(parent if self.spec.prefer == "child" else child)
        return self._drop("hierarchy", gone, features)
