"""Experiments: load, filter, split first, enrich, prepare, fit two legs, report."""

from __future__ import annotations

import hashlib
import json
import time
import warnings
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..config import ContextSpec, variant
from ..sources.files import append_json, write_json
from ..sources.registry import Dataset, Registry
from ..sources.storage import Storage
from .context import ContextEstimator
from .folds import random_holdout, sample_rows, temporal_holdout
from .guards import promotion
from .models import train_model
from .prepare import encoded, positive_target, pruned_columns, vocabulary


@dataclass(frozen=True)
class Experiment:
    name: str
    target: str
    keys: tuple[str, ...]
    numeric: tuple[str, ...]
    row_key: tuple[str, ...]
    time_col: str | None = None
    variant: str = "full"
    strategy: str = "random"
    holdout: float = 0.2
    sample: int | None = None  # rows to keep, if not all
    model: str = "gradient_boosting"
    n_folds: int = 5
    seed: int = 42

    def __post_init__(self):
        if self.time_col and self.strategy == "random":
            raise ValueError("a split in time needs folds in time: strategy time or rolling")


@dataclass
class Result:
    name: str
    baseline: dict
    context: dict
    improvement: float
    delta_r2: float
    importances: dict[str, float]
    dominance: float
    metadata: dict
    unseen: dict[str, int] = field(default_factory=dict)

    def save(self, folder: str) -> None:
        write_json(asdict(self), f"{folder}/{self.name}.json")
        append_json({"name": self.name, "improvement": self.improvement, **self.metadata}, f"{folder}/runs.jsonl")
        Storage().write_text(f"{folder}/{self.name}.md", report(self))


def report(r: Result) -> str:
    rows = "\n".join(f"| {k} | {r.baseline[k]:.4f} | {r.context[k]:.4f} |" for k in ("rmse", "mae", "r2"))
    return f"# {r.name}\n\n| metric | baseline | context |\n|-|-|-|\n{rows}\n\nImprovement: {r.improvement:.2f} %. Share of the three most important features: {r.dominance:.2f}.\n"


def config_hash(e: Experiment) -> str:
    return hashlib.sha256(json.dumps(asdict(e), sort_keys=True, default=str).encode()).hexdigest()[:16]


def split_rows(df: DataFrame, e: Experiment) -> tuple[DataFrame, DataFrame]:
    cut = temporal_holdout(df, e.time_col, share=e.holdout) if e.time_col else random_holdout(df, list(e.row_key), e.holdout, e.seed)
    return cut.where("split = 'train'").drop("split"), cut.where("split = 'test'").drop("split")


def run_experiment(df: DataFrame, e: Experiment) -> Result:
    began = time.time()
    df = positive_target(df, e.target)
    if e.sample:
        df = sample_rows(df, list(e.row_key), e.sample, e.seed)
    train, test = split_rows(df, e)
    spec = ContextSpec(e.target, e.keys, variant(e.variant), strategy=e.strategy, n_folds=e.n_folds, seed=e.seed, time_col=e.time_col, tie_cols=e.row_key)
    train, model = ContextEstimator(spec, e.row_key).fit_transform(train)
    test = model.transform(test)
    context = [c for c in test.columns if f"_{e.target}_" in c and c in train.columns and not c.startswith("global_")]
    codes = {k: vocabulary(train, k) for k in e.keys}
    for k, v in codes.items():
        train, test = encoded(train, k, v), encoded(test, k, v)
    base = [*e.numeric, *[f"{k}_code" for k in e.keys]]
    dropped = set(pruned_columns(train.select(*base, *context)))
    base, context = ([c for c in cs if c not in dropped] for cs in (base, context))
    train, test = (d.select(*base, *context, e.target).persist() for d in (train, test))
    try:
        plain = train_model(e.model, train, base, e.target, test, seed=e.seed)
        rich = train_model(e.model, train, [*base, *context], e.target, test, seed=e.seed)
    finally:
        train.unpersist()
        test.unpersist()
    a, b = asdict(plain.test), asdict(rich.test)
    top = sorted(rich.importances.values(), reverse=True)
    return Result(e.name, a, b, (a["rmse"] - b["rmse"]) / a["rmse"] * 100 if a["rmse"] else 0.0, b["r2"] - a["r2"], rich.importances, sum(top[:3]) / (sum(top) or 1), {"config_hash": config_hash(e), "seconds": round(time.time() - began, 1)})


def run_all(frames: dict[str, DataFrame], experiments: list[Experiment], folder: str | None = None, diagnostics: dict | None = None) -> list[Result]:
    """Every experiment over its frame; failures are warned of and recorded, not fatal. The gate goes into the metadata."""
    out = []
    for e in experiments:
        try:
            r = run_experiment(frames[e.name], e)
        except Exception as error:
            warnings.warn(f"{e.name} failed: {str(error)[:500]}", stacklevel=2)
            if folder:
                append_json({"name": e.name, "error": str(error)[:500]}, f"{folder}/failures.jsonl")
            continue
        r.metadata["gate"] = promotion(diagnostics or {})
        if folder:
            r.save(folder)
        out.append(r)
    return out


def experiment_of(d: Dataset) -> Experiment:
    """The experiment that a dataset's file describes in its [experiment] section; target and time column default to the dataset's."""
    given = {"name": d.name, "target": d.target, "time_col": d.time_col} | d.settings.get("experiment", {})
    if unknown := set(given) - {f.name for f in fields(Experiment)}:
        raise ValueError(f"{d.name}: unknown settings {sorted(unknown)}")
    if missing := [k for k in ("target", "keys", "numeric", "row_key") if not given.get(k)]:
        raise ValueError(f"{d.name}: missing settings {missing}")
    return Experiment(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def run_registered(spark: SparkSession, registry: Registry, names: list[str] | None = None, folder: str | None = None) -> list[Result]:
    """The experiments of the named datasets, or of all that describe one."""
    found = [registry.info(n) for n in names or registry.names()]
    chosen = [d for d in found if names or "experiment" in d.settings]
    return run_all({d.name: spark.read.parquet(d.path) for d in chosen}, [experiment_of(d) for d in chosen], folder)


def compare_key_modes(df: DataFrame, e: Experiment) -> dict:
    """The experiment with its own keys and with detected ones, and the differences."""
    from dataclasses import replace

    from .levels import detect_keys

    found = tuple(detect_keys(df, (e.target, *e.row_key, *e.numeric, *([e.time_col] if e.time_col else []))))
    manual, auto = run_experiment(df, e), run_experiment(df, replace(e, keys=found))
    deltas = {f"{leg}_{k}": getattr(auto, leg)[k] - getattr(manual, leg)[k] for leg in ("baseline", "context") for k in ("rmse", "r2")}
    return {"manual": asdict(manual), "auto": asdict(auto), "keys": found, "auto_minus_manual": deltas | {"improvement": auto.improvement - manual.improvement}}
