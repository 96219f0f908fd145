"""Panel features and their context: joins, labels and keys around the context engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureSpec, HierarchySpec, LagSpec
from ..functions.windows import add_technical_features, apply_lags
from .asof import join_unique
from .context import ContextEstimator, ContextModel
from .prepare import first_of

SECTOR_COLUMNS = ("sector", "industry", "mktcap_bucket")
SENTIMENT_COLUMNS = ("sentiment_score", "sentiment_pos", "sentiment_neg", "sentiment_neu")


def build_features(prices: DataFrame, sentiment: DataFrame | None = None, spec: FeatureSpec = FeatureSpec(), lags: LagSpec = LagSpec(), key: str = "ticker", ts: str = "period_close_ts") -> DataFrame:
    """Technical features, optional sentiment per (key, ts) filled by 0 with a flag, and lags of both."""
    out = add_technical_features(prices, spec, key, ts)
    columns = [c for c in out.columns if c not in prices.columns]
    if sentiment is not None:
        wanted = [c for c in (*SENTIMENT_COLUMNS, "n_articles") if c in sentiment.columns]
        out = join_unique(out, sentiment.select(key, ts, *wanted), [key, ts], {c: 0 for c in wanted}, "has_sentiment")
        columns += wanted
    return apply_lags(out, columns, lags, key, ts)


class PanelEnricher:
    """Rolling cross-fitted context of a panel over tickers, sectors and months."""

    def __init__(self, sectors: DataFrame, spec: HierarchySpec = HierarchySpec(), ts: str = "period_close_ts", order: list | None = None):
        self.spec, self.ts = spec, ts
        self.sectors = first_of(sectors, ["ticker"], order or list(SECTOR_COLUMNS)).select("ticker", *SECTOR_COLUMNS)
        self.prepared: DataFrame | None = None

    def prepare(self, features: DataFrame) -> DataFrame:
        """Sector columns (unknown where missing), the UTC month, the target from past-only returns; forward labels go."""
        if missing := [c for c in ("ticker", self.ts) if c not in features.columns]:
            raise ValueError(f"missing columns {missing}")
        target = self.spec.target
        gone = [c for c in features.columns if c in SECTOR_COLUMNS or c.startswith("ret_h") and c != target]
        joined = features.drop(*gone).join(self.sectors, "ticker", "left")
        named = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) if c in SECTOR_COLUMNS else F.col(c) for c in joined.columns]
        out = joined.select(*named, F.date_format(self.ts, "yyyy-MM").alias("time_bucket"))
        if target == "ret_1d" and "ret_1d_log" in out.columns:
            out = out.drop("ret_1d_log") if "ret_1d" in out.columns else out.withColumnRenamed("ret_1d_log", "ret_1d")
        if target not in out.columns:
            raise ValueError(f"target {target} is missing")
        return out

    def fit_transform(self, features: DataFrame) -> tuple[DataFrame, ContextModel]:
        """Only allowed interactions are ever computed, so nothing is filtered afterwards."""
        self.prepared = self.prepare(features)
        return ContextEstimator(self.spec.context(self.ts)).fit_transform(self.prepared)

    def transform_partial(self, rows: DataFrame, boundary, start=None) -> DataFrame:
        """Refit on prepared rows in [start, boundary], join to rows strictly after it."""
        if self.prepared is None:
            raise RuntimeError("fit_transform comes first")
        window = self.prepared.where(F.col(self.ts) <= F.lit(boundary))
        if start is not None:
            window = window.where(F.col(self.ts) >= F.lit(start))
        if window.isEmpty():
            raise ValueError("no rows to fit on")
        new = self.prepare(rows)
        if not new.where(F.col(self.ts) <= F.lit(boundary)).isEmpty():
            raise ValueError("rows at or before the boundary would see later ones")
        return ContextEstimator(self.spec.context(self.ts)).fit(window).transform(new)
