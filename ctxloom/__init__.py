"""Leakage-safe statistical feature engineering expressed as Spark plans."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_WHERE = {
    "config": ("ContextSpec", "CleanupSpec", "FeatureSpec", "HierarchySpec", "LagSpec", "WalkForwardSpec", "variant"),
    "functions.aggregates": ("STATS", "refined_quantiles"),
    "functions.windows": ("add_technical_features", "apply_lags", "forward_targets"),
    "operators.cleanup": ("Cleanup",),
    "operators.context": ("ContextEstimator", "ContextModel"),
    "operators.enrich": ("PanelEnricher", "build_features"),
    "operators.forecast": ("run_baseline_vs_context", "run_walk_forward"),
    "operators.levels": ("detect_keys", "level_stats"),
    "operators.models": ("FeatureSearch", "build_model", "iterative_pruning", "train_model"),
    "operators.runner": ("Experiment", "run_all", "run_experiment"),
    "operators.selection": ("SignificanceSelector", "lm_statistics", "select_significant"),
    "sources.registry": ("Registry", "Store"),
}
_HOME = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    """Public names load with their module on first use."""
    if name in _HOME:
        return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
    raise AttributeError(name)
