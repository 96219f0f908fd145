"""Named datasets and universes in TOML files; stores with markers and content hashes."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Storage

MARKER = ".ctxloom_store"


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    target: str | None = None
    time_col: str | None = None
    settings: dict = field(default_factory=dict)


class Registry:
    """Datasets described by {name}.toml files in a folder: [data] path, target, time_col, and free sections."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.toml"))

    def info(self, name: str) -> Dataset:
        p = Path(name) if name.endswith(".toml") else self.folder / f"{name}.toml"
        if not p.exists():
            raise KeyError(f"unknown dataset {name!r}; known: {self.names()}")
        raw = tomllib.loads(p.read_text())
        data = raw.get("data", {})
        path = Path(data["path"])
        return Dataset(p.stem, str(path if path.is_absolute() else p.parent / path), data.get("target"), data.get("time_col"), raw)

    def load(self, spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
        df = spark.read.parquet(self.info(name).path)
        return df.select(*columns) if columns else df

    def register_views(self, spark: SparkSession) -> list[str]:
        """Every dataset that is there, as a temporary view of its name."""
        found = [n for n in self.names() if Path(self.info(n).path).exists()]
        for n in found:
            self.load(spark, n).createOrReplaceTempView(n)
        return found

    def verify(self, manifest: str | None = None) -> dict[str, bool]:
        """Sizes and SHA-256 sums of a manifest ({file: {sha256, bytes}}) against the files."""
        wanted = json.loads(Path(manifest or self.folder / "manifest.json").read_text())
        return {name: _matches(self.folder / name, entry) for name, entry in wanted.items()}


def _matches(path: Path, entry: dict) -> bool:
    if not path.is_file() or path.stat().st_size != entry["bytes"]:
        return False
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest() == entry["sha256"]


def manifest_of(folder: str, pattern: str = "*.parquet") -> dict:
    return {p.name: {"bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(Path(folder).glob(pattern)) if p.is_file()}


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that their order does not change: sums of two row hashes and the count, hashed."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)"))).first()
    return hashlib.sha256("|".join(map(str, [*sorted(df.columns), *row])).encode()).hexdigest()


def _instant(text: str) -> datetime:
    """An ISO date or time; without an offset it is UTC."""
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


class Store:
    """A folder on shared storage that may be overwritten because it carries a marker and lies within a root."""

    def __init__(self, root: str, name: str, spark: SparkSession | None = None):
        if ":" in name or not all(part.strip(".") for part in name.split("/")):
            raise ValueError(f"{name!r} is no name within {root}")
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}"
        self.marker, self.meta_path = f"{self.path}/{MARKER}", f"{self.path}.meta.json"

    @property
    def storage(self) -> Storage:
        return Storage(self.spark)

    def clear(self) -> None:
        """Remove the folder if it is a store; anything else is left alone."""
        if not self.storage.exists(self.path):
            return
        if not self.storage.exists(self.marker):
            raise PermissionError(f"{self.path} carries no {MARKER}")
        self.storage.delete(self.meta_path)
        self.storage.delete(self.path)

    def write(self, df: DataFrame, ts: str, window: tuple[str, str] | None = None) -> dict:
        """Marker first, facts about the stored rows last: a write that broke off can be cleared, and covers nothing."""
        from .files import write_partitioned

        self.clear()
        self.storage.write_text(self.marker, "")
        write_partitioned(df, self.path, ts, mode="append")
        stored = df.sparkSession.read.parquet(self.path).select(*df.columns)
        meta = {"rows": stored.count(), "sha256": content_hash(stored), "window": list(window) if window else None}
        self.storage.write_text(self.meta_path, json.dumps(meta))
        return meta

    def covers(self, start: str, end: str) -> bool:
        """Whether what is stored spans the window, so nothing needs to be fetched."""
        if not self.storage.exists(self.meta_path) or not self.storage.exists(self.marker):
            return False
        window = json.loads(self.storage.read_text(self.meta_path)).get("window")
        return bool(window) and _instant(window[0]) <= _instant(start) and _instant(end) <= _instant(window[1])
