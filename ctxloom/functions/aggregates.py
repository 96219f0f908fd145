"""The target statistics, each an aggregate expression over one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPSILON

#: Names of quantile statistics with their probabilities.
QUANTILES = {f"q{p:02d}": p / 100 for p in (5, 10, 20, 25, 33, 66, 75, 80, 90, 95)}

#: Statistics that are plain aggregates: computed map-side and merged.
MOMENTS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "cv": lambda y: F.try_divide(F.stddev_pop(y), F.avg(y) + F.lit(EPSILON)),
    "min": F.min,
    "max": F.max,
    "range": lambda y: F.max(y) - F.min(y),
    "count": F.count,
    "sum": lambda y: F.coalesce(F.sum(y), F.lit(0.0)),
}

#: Probabilities that each order statistic needs.
ORDER = {"median": (0.5,), "iqr": (0.25, 0.75)} | {k: (p,) for k, p in QUANTILES.items()}

STATS = tuple([*MOMENTS, *ORDER])


def probabilities(stats: tuple[str, ...]) -> tuple[float, ...]:
    """All probabilities the statistics need, sorted: one percentile call computes them together."""
    return tuple(sorted({p for s in stats for p in ORDER.get(s, ())}))


def aggregates(y: Column, stats: tuple[str, ...]) -> list[Column]:
    """Aggregate columns named by statistic, and `__p` (array of the needed percentiles) if there are any."""
    y = y.cast("double")
    out = [MOMENTS[s](y).alias(s) for s in stats if s in MOMENTS]
    if p := probabilities(stats):
        out.append(F.percentile(y, F.array(*map(F.lit, p))).alias("__p"))
    return out


def unpacked(stats: tuple[str, ...], p: Column | None = None) -> list[Column]:
    """The statistics in the order asked for, with percentiles taken out of their array."""
    known = {q: k for k, q in enumerate(probabilities(stats))}
    array = F.col("__p") if p is None else p
    at = lambda q: F.get(array, F.lit(known[q]))
    return [F.col(s) if s in MOMENTS else (at(0.75) - at(0.25) if s == "iqr" else at(ORDER[s][0])).alias(s) for s in stats]


#: Values that percentile() may hold for one group.
HELD_AT_ONCE = 1_000_000


def group_is_large(df: DataFrame, keys: list[str]) -> bool:
    """Whether any group has more rows than percentile() should hold; one count by keys."""
    if not keys:
        return df.limit(HELD_AT_ONCE + 1).count() > HELD_AT_ONCE
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HELD_AT_ONCE).isEmpty()


def quantiles_of(df: DataFrame, keys: list[str], y: str, probs: tuple[float, ...]) -> DataFrame:
    """Exact linear-interpolated quantiles, keys and `__p`, by percentile() or, where a group is too large for it, by ranges."""
    if group_is_large(df, keys):
        return refined_quantiles(df, keys, y, probs)
    rows = df.where(F.col(y).isNotNull()).groupBy(*keys)
    return rows.agg(F.percentile(F.col(y).cast("double"), F.array(*map(F.lit, probs))).alias("__p")).where("__p IS NOT NULL")


def refined_quantiles(df: DataFrame, keys: list[str], y: str, probs: tuple[float, ...], slots: int = 4096, rounds: int = 3) -> DataFrame:
    """Exact linear-interpolated quantiles of large groups: keys and `__p`, as percentile() gives them.

    percentile() holds a group's distinct values in one task.  Here values are
    counted into `slots` ranges, and the ranges that hold a wanted rank are split
    again, `rounds` times in all, before what is left of them is sorted.  The first
    ranges are of equal width on a logarithmic scale of both signs, so outliers of
    any size leave the others apart; later ones are of equal width between the
    extremes of the range they split.  Null values are skipped; a group of nulls
    has nulls.
    """
    if not keys:
        return refined_quantiles(df.select(F.lit(0).alias("__g"), y), ["__g"], y, probs, slots, rounds).drop("__g")
    value = F.col(y).cast("double")
    rows = df.select(*keys, value.alias("__y")).where("__y IS NOT NULL").groupBy(*keys, "__y").agg(F.count(F.lit(1)).alias("__c"))
    # slot 0 of a logarithmic scale that covers all doubles is the middle, where zero is
    size = F.floor((F.log2(F.abs("__y")) + 1075) / 2100 * (slots // 2 - 1)) + 1
    first = F.when(F.col("__y") == 0, F.lit(0)).otherwise(F.signum("__y") * F.least(F.greatest(size, F.lit(1)), F.lit(slots // 2))).cast("long")
    placed = rows.withColumn("__s", first)
    per_slot = _counted(placed, keys, [])
    totals = per_slot.groupBy(*keys).agg(F.sum("__cs").alias("__n"))
    # ranks from 0: each probability needs floor and ceiling of p*(n-1)
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(p).alias("p")) for k, p in enumerate(probs)]))
    wanted = totals.select(*keys, "__n", ranks.alias("__r")).select("*", (F.col("__r.p") * (F.col("__n") - 1)).alias("__at"))
    wanted = wanted.select(*keys, "__r", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank"))
    holds = "__rank >= __before AND __rank < __before + __cs"
    wanted = _on_keys(wanted, per_slot, keys).where(holds).drop("__cs")
    for _ in range(rounds - 1):
        # the slots that hold a rank, split between their extremes
        kept = wanted.select(*keys, "__s", "__before", "__lo", "__hi").distinct()
        slot = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__y") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * slots), F.lit(slots - 1))).otherwise(F.lit(0)).cast("long")
        inside = _on_keys(placed.select(*keys, "__s", "__y", "__c"), kept, [*keys, "__s"]).withColumn("__t", slot)
        placed = inside.select(*keys, F.xxhash64("__s", "__t").alias("__s"), F.col("__s").alias("__of"), "__t", "__y", "__c", "__before")
        per_slot = _counted(placed, keys, ["__of", "__t", "__before"])
        wanted = _on_keys(wanted.select(*keys, F.col("__s").alias("__of"), "__r", "__at", "__rank"), per_slot, [*keys, "__of"]).where(holds).drop("__cs", "__of", "__t")
    inside = _on_keys(placed.select(*keys, "__s", "__y", "__c"), wanted.select(*keys, "__s", "__before").distinct(), [*keys, "__s"])
    up = Window.partitionBy(*keys, "__s").orderBy("__y").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__end", F.col("__before") + F.sum("__c").over(up))
    found = _on_keys(wanted.select(*keys, "__s", "__r", "__at", "__rank"), inside.select(*keys, "__s", "__y", "__c", "__end"), [*keys, "__s"])
    found = found.where("__rank < __end AND __rank >= __end - __c")
    low, high = F.min_by("__y", "__rank"), F.max_by("__y", "__rank")
    each = found.groupBy(*keys, "__r").agg((low + (high - low) * (F.first("__at") - F.floor(F.first("__at")))).alias("__v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__r.i").alias("i"), "__v"))), lambda x: x["__v"]).alias("__p"))


def _counted(placed: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """A row per slot: its count, extremes, and the values before it; within a split slot (more) from that slot's start."""
    out = placed.groupBy(*keys, "__s", *more).agg(F.sum("__c").alias("__cs"), F.min("__y").alias("__lo"), F.max("__y").alias("__hi"))
    order, by = ("__t", [*keys, "__of"]) if more else ("__s", keys)
    running = F.sum("__cs").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cs")
    return out.withColumn("__before", running + F.col("__before") if more else running)


def _on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on null-safe keys that keeps one copy of them."""
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(renamed, condition, "inner").drop(*[f"__k_{k}" for k in keys])
