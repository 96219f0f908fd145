"""Settings of the context engine, the feature builders and the walk-forward runner."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults and choices that results depend on.
DEFAULT_STATS = ("mean", "median", "std", "q05", "q20", "q80", "q95", "count")
STRATEGIES = ("random", "time", "rolling", "off")
FOLD_FEATURES = ("std", "cv", "lower", "upper")
EPSILON = 1e-8


@dataclass(frozen=True)
class CleanupSpec:
    leakage_drop: float = 0.95
    leakage_warn: float = 0.85
    correlation: float = 0.9
    method: str = "pearson"
    strategy: str = "lower_target_corr"
    use_vif: bool = False
    max_vif: float = 10.0
    use_hierarchy: bool = True
    hierarchy_correlation: float = 0.95
    prefer: str = "child"
    min_variance: float = 1e-10

    def __post_init__(self):
        if self.method not in ("pearson", "spearman"):
            raise ValueError("method is pearson or spearman")
        if self.strategy not in ("lower_target_corr", "lower_variance", "first", "hierarchy"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.prefer not in ("child", "parent"):
            raise ValueError("prefer is child or parent")


@dataclass(frozen=True)
class ContextSpec:
    """What to compute for a target over which keys, and how to keep it out-of-fold."""

    target: str
    keys: tuple[str, ...] | None = None  # None: detect
    stats: tuple[str, ...] = DEFAULT_STATS
    min_group_size: int = 5
    strategy: str = "random"
    n_folds: int = 5
    seed: int = 42
    time_col: str | None = None
    tie_cols: tuple[str, ...] = ()
    test_size: int | None = None
    max_train_size: int | None = None
    gap: int = 0
    fold_variance: bool = True
    fold_features: tuple[str, ...] = ("std", "lower", "upper")
    relative: bool = False
    global_stats: bool = True
    interactions: bool = True
    depth: int = 2
    allowed_interactions: tuple[tuple[str, ...], ...] | None = None
    max_cardinality: int = 100
    backoff_depth: bool = False
    cleanup: CleanupSpec | None = None
    min_keys: int = 1
    pooled_store: bool = False
    quantiles: str = "auto"  # of keyed levels: "refined" where a group is too large to be held in one task, else "percentile"
    exclude: tuple[str, ...] = ()

    def __post_init__(self):
        from .functions.aggregates import STATS

        if self.n_folds < 2:
            raise ValueError("n_folds must be at least 2")
        if self.min_group_size < 1:
            raise ValueError("min_group_size must be at least 1")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        if self.strategy in ("time", "rolling") and not self.time_col:
            raise ValueError(f"strategy {self.strategy} needs time_col")
        for name in ("test_size", "max_train_size"):
            if (v := getattr(self, name)) is not None and v < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.gap < 0:
            raise ValueError("gap must not be negative")
        if self.quantiles not in ("auto", "percentile", "refined"):
            raise ValueError("quantiles is auto, percentile or refined")
        if self.depth < 1:
            raise ValueError("depth must be at least 1")
        if unknown := set(self.fold_features) - set(FOLD_FEATURES):
            raise ValueError(f"unknown fold features {sorted(unknown)}")
        if unknown := set(self.stats) - set(STATS):
            raise ValueError(f"unknown statistics {sorted(unknown)}")
        if self.strategy == "random" and self.fold_variance and self.n_folds < 3:
            raise ValueError("fold variance needs n_folds of at least 3, or training and later rows differ in columns")
        for k in self.keys or ():
            if k == "global" or "__" in k:
                raise ValueError(f"key {k!r} clashes with level names")

    def with_keys(self, keys: tuple[str, ...]) -> ContextSpec:
        from dataclasses import replace

        return replace(self, keys=tuple(keys))


@dataclass(frozen=True)
class FeatureSpec:
    """Windows of the technical features."""

    returns: tuple[int, ...] = (1, 5, 10, 21)
    sma: tuple[int, ...] = (5, 10, 21, 63)
    ema: tuple[int, ...] = (5, 10, 21, 63)
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    volatility: tuple[int, ...] = (21, 63)
    volume_z: int = 21
    atr: int = 14
    bollinger: tuple[int, float] = (20, 2.0)

    def describe(self) -> dict[str, int]:
        out = {"returns": len(self.returns), "sma": len(self.sma), "ema": len(self.ema), "rsi": 1, "macd": 3, "volatility": len(self.volatility), "volume_zscore": 1, "atr": 1, "bollinger": 3}
        return out | {"total": sum(out.values())}


@dataclass(frozen=True)
class LagSpec:
    windows: tuple[int, ...] = (1, 3, 5, 10, 21)
    methods: tuple[str, ...] = ("lag", "rollmean", "rollstd")

    def __post_init__(self):
        if any(n < 1 for n in self.windows):
            raise ValueError("windows must be at least 1")
        if unknown := set(self.methods) - {"lag", "rollmean", "rollstd"}:
            raise ValueError(f"unknown methods {sorted(unknown)}")

    def describe(self, columns: int) -> int:
        return columns * len(self.windows) * len(self.methods)


@dataclass(frozen=True)
class HierarchySpec:
    """Keys and interactions of the panel context."""

    target: str = "ret_1d"
    keys: tuple[str, ...] = ("ticker", "sector", "industry", "mktcap_bucket", "time_bucket")
    interactions: tuple[tuple[str, str], ...] = (("sector", "time_bucket"), ("industry", "time_bucket"), ("mktcap_bucket", "time_bucket"), ("sector", "mktcap_bucket"))
    min_group_size: int = 20
    n_folds: int = 5

    def context(self, time_col: str = "period_close_ts") -> ContextSpec:
        return ContextSpec(self.target, self.keys, min_group_size=self.min_group_size, strategy="rolling", n_folds=self.n_folds, time_col=time_col, tie_cols=("ticker",), allowed_interactions=self.interactions)


@dataclass(frozen=True)
class WalkForwardSpec:
    horizons: tuple[int, ...] = (1, 5, 10, 21, 63)
    quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)
    train: int = 1260
    val: int = 63
    test: int = 63
    step: int = 63
    max_folds: int | None = None
    trees: int = 80
    depth: int = 4
    rate: float = 0.08
    oof_folds: int = 3
    hierarchy: HierarchySpec = field(default_factory=HierarchySpec)

    def __post_init__(self):
        if min(self.train, self.val, self.test, self.step) < 1:
            raise ValueError("window lengths and step must be at least 1")
        if not self.horizons or min(self.horizons) < 1:
            raise ValueError("horizons must be at least 1")
        if not all(0 < q < 1 for q in self.quantiles):
            raise ValueError("quantiles lie between 0 and 1")

    def metadata(self) -> dict:
        from dataclasses import asdict

        return asdict(self)


# Named sets of statistics.
VARIANTS = {
    "full": DEFAULT_STATS,
    "target_mean": ("mean",),
    "mean_count": ("mean", "count"),
    "mean_std_count": ("mean", "std", "count"),
}
VARIANT_LABELS = {"full": "Full context", "target_mean": "Target mean", "mean_count": "Mean and count", "mean_std_count": "Mean, std and count"}


def variant(name: str) -> tuple[str, ...]:
    key = name.strip().lower().replace("-", "_").replace("+", "_")
    if key not in VARIANTS:
        raise ValueError(f"unknown variant {name!r}; known: {sorted(VARIANTS)}")
    return VARIANTS[key]
