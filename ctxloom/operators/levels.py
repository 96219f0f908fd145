"""Group statistics of a target at several levels: single keys, their combinations, and all rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import MOMENTS, aggregates, group_is_large, probabilities, refined_quantiles, unpacked

Level = tuple[str, ...]  # () is all rows


def level_name(level: Level) -> str:
    return "__".join(level) or "global"


def make_levels(keys: tuple[str, ...], interactions: bool = True, depth: int = 2, allowed: tuple[Level, ...] | None = None) -> list[Level]:
    """Single keys, then combinations by size; an allow-list is applied before anything is computed."""
    for k in keys:
        if k == "global" or "__" in k:
            raise ValueError(f"key {k!r} clashes with level names")
    out: list[Level] = [(k,) for k in keys]
    wanted = None if allowed is None else {frozenset(a) for a in allowed}
    for size in range(2, min(depth, len(keys)) + 1 if interactions else 2):
        out += [c for c in combinations(keys, size) if wanted is None or frozenset(c) in wanted]
    return out


def merged_keys(hierarchy: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    """Two lists of keys as one, in order, without repeats."""
    return tuple(dict.fromkeys([*hierarchy, *more]))


def level_stats(df: DataFrame, level: Level, target: str, stats: tuple[str, ...], min_size: int = 1, extra: tuple[str, ...] = (), quantiles: str = "auto") -> DataFrame:
    """Statistics of one level: extra and level columns, then one column per statistic.

    Null keys are a group of their own; null targets are skipped.  The size that
    min_size is held against is the number of targets if `count` is among the
    statistics, else the number of rows.  quantiles="refined" computes order
    statistics without holding a group in one task, "auto" does so if a count
    finds a group too large for that; both give the same values.
    """
    by = [*extra, *level]
    if quantiles == "auto":
        quantiles = "refined" if probabilities(stats) and group_is_large(df, by) else "percentile"
    size = F.count(F.col(target)) if "count" in stats else F.count(F.lit(1))
    if quantiles == "refined" and (p := probabilities(stats)):
        moments = df.groupBy(*by).agg(size.alias("__size"), *aggregates(F.col(target), tuple(s for s in stats if s in MOMENTS)))
        ranked = refined_quantiles(df, by, target, p)
        if by:
            both = moments.join(ranked.select(*[F.col(k).alias(f"__k_{k}") for k in by], "__p"), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by], "left")
        else:
            both = moments.join(F.broadcast(ranked.limit(1)), F.lit(True), "left")  # one row, or none without values
    else:
        both = df.groupBy(*by).agg(size.alias("__size"), *aggregates(F.col(target), stats))
    return both.where(F.col("__size") >= min_size).select(*by, *unpacked(stats))


def global_stats(df: DataFrame, target: str, stats: tuple[str, ...], extra: tuple[str, ...] = (), quantiles: str = "auto") -> DataFrame:
    """One row (per extra) of statistics of all non-null targets."""
    return level_stats(df.where(F.col(target).isNotNull()), (), target, stats, 1, extra, quantiles)


def moments_by_grouping_sets(df: DataFrame, levels: list[Level], target: str, stats: tuple[str, ...], min_size: int = 1) -> DataFrame:
    """All levels of mergeable statistics in one pass: level name, every key (null where rolled up), statistics."""
    if bad := [s for s in stats if s not in MOMENTS]:
        raise ValueError(f"{bad} are order statistics: compute them level by level")
    keys = list(dict.fromkeys(k for level in levels for k in level))
    sets = [[F.col(k) for k in level] for level in levels]
    size = F.count(F.col(target)) if "count" in stats else F.count(F.lit(1))
    gid = F.grouping_id(*[F.col(k) for k in keys])
    out = df.groupingSets(sets, *keys).agg(gid.alias("__g"), size.alias("__size"), *aggregates(F.col(target), stats)).where(F.col("__size") >= min_size)
    name: Column = F.lit(None).cast("string")
    for level in levels:
        code = sum(1 << (len(keys) - 1 - k) for k, c in enumerate(keys) if c not in level)
        name = F.when(F.col("__g") == code, F.lit(level_name(level))).otherwise(name)
    return out.select(name.alias("level"), *keys, *stats)


def with_extra_quantiles(stats: DataFrame, df: DataFrame, level: Level, target: str) -> DataFrame:
    """Left-join quartiles of a single-column level that have no size limit of their own."""
    quartiles = level_stats(df, level, target, ("q25", "q75"))
    right = quartiles.select(*[F.col(k).alias(f"__k_{k}") for k in level], "q25", "q75")
    return stats.join(right, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in level], "left").drop(*[f"__k_{k}" for k in level])


def cardinalities(df: DataFrame, keys: tuple[str, ...]) -> dict[str, int]:
    """Distinct values of each key, null counted as one, in a single job."""
    if not keys:
        return {}
    row = df.agg(*[(F.count_distinct(F.col(k)) + F.coalesce(F.max(F.col(k).isNull().cast("int")), F.lit(0))).alias(k) for k in keys]).first()
    return row.asDict()


def detect_keys(df: DataFrame, exclude: tuple[str, ...] = (), max_cardinality: int = 100) -> list[str]:
    """Columns that can serve as keys: strings and booleans, and integers distinct in under a tenth of the rows, with 2 to max_cardinality values."""
    from pyspark.sql import types as T

    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType) and f.name not in exclude]
    if not text and not whole:
        return []
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_distinct(c).alias(c) for c in [*text, *whole]]).first()
    fits = lambda c: 2 <= row[c] <= max_cardinality and (c in text or row[c] < 0.1 * row["__n"])
    return [c for c in df.columns if c in {*text, *whole} and fits(c)]
