"""Fallback of missing statistics along a chain of coarser levels."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .levels import Level, level_name


def fallback_chain(level: Level, cardinality: dict[str, int], known: set[Level]) -> list[Level]:
    """Coarser levels to try in turn: smaller subsets, least total cardinality first, then all rows."""
    out: list[Level] = []
    for size in range(len(level) - 1, 0, -1):
        subsets = [c for c in combinations(level, size) if c in known]
        out += sorted(subsets, key=lambda c: sum(cardinality[k] for k in c))
    return [*out, ()]


def column(level: Level, target: str, stat: str) -> str:
    return f"{level_name(level)}_{target}_{stat}"


def apply_backoff(df: DataFrame, levels: list[Level], target: str, stats: tuple[str, ...], cardinality: dict[str, int], depth: bool = False, has_global: bool = True) -> DataFrame:
    """Fill each level's nulls from its chain; without global statistics nothing is filled.

    Levels are filled from coarse to fine, so a level meets its fallbacks already
    filled.  With depth, `{level}_backoff_depth` tells where the mean came from:
    0 the level itself, i the i-th fallback, -1 nowhere.
    """
    if not has_global:
        return df
    ordered = sorted(levels, key=len)
    filled: dict[tuple[Level, str], Column] = {((), s): F.col(column((), target, s)) for s in stats}
    depths: dict[Level, Column] = {}
    for level in ordered:
        chain = fallback_chain(level, cardinality, set(levels))
        for s in stats:
            own = F.col(column(level, target, s))
            filled[level, s] = F.coalesce(own, *[filled[c, s] for c in chain])
        if depth:
            s = "mean" if "mean" in stats else stats[0]
            expr = F.when(F.col(column(level, target, s)).isNotNull(), F.lit(0))
            for k, c in enumerate(chain, 1):
                expr = expr.when(filled[c, s].isNotNull(), F.lit(k))
            depths[level] = expr.otherwise(F.lit(-1))
    names = {column(level, target, s): filled[level, s] for level in levels for s in stats}
    kept = [names[c].alias(c) if c in names else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *[d.alias(f"{level_name(level)}_backoff_depth") for level, d in depths.items()])


def backoff_summary(df: DataFrame) -> DataFrame:
    """Mean, maximum, and share above 0 of every backoff depth column: one row per level."""
    depths = [c for c in df.columns if c.endswith("_backoff_depth")]
    parts = F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_backoff_depth")).alias("level"), F.col(c).alias("depth")) for c in depths])).alias("d")
    return df.select(parts).groupBy("d.level").agg(F.avg("d.depth").alias("mean_depth"), F.max("d.depth").alias("max_depth"), F.avg((F.col("d.depth") > 0).cast("double")).alias("share_backed_off"))
