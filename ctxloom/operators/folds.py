"""Fold and split generators: fold columns and fold tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def random_fold(df: DataFrame, key: list[str], n_folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Hash folds: deterministic, without a shuffle; sizes differ by chance only."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *map(F.col, key)), F.lit(n_folds)).cast("int"))


def hash_place(df: DataFrame, key: list[str], seed: int = 42, name: str = "place") -> DataFrame:
    """df with the global position of each row in hash order; folds and a split of one seed can share it."""
    return positions(df.withColumn("__h", F.xxhash64(F.lit(seed), *map(F.col, key))), ["__h", *key], name, hashed=True).drop("__h")


def balanced_fold(df: DataFrame, key: list[str], n_folds: int, seed: int = 42, name: str = "fold", place: str | None = None) -> DataFrame:
    """Folds whose sizes differ by at most one row, by global position in hash order; place is a column that holds it already."""
    numbered = df if place else hash_place(df, key, seed, "__pos")
    return numbered.withColumn(name, F.pmod(F.col(place or "__pos"), F.lit(n_folds)).cast("int")).drop("__pos")


def pieces(df: DataFrame) -> int:
    """Partitions for a sort: the session's, or up to four times as many where they are few, so that little is sorted at a time."""
    own = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(own, min(4 * own, 64))


def positions(df: DataFrame, order: list[str], name: str = "position", weight: str | None = None, hashed: bool = False) -> DataFrame:
    """The row's 0-based place in a global order, or the weight before it, without putting all rows into one task.

    Ranges of the order key are cut at bounds from a fixed sample (the rows of
    smallest hash), rows are numbered within ranges, and range sizes - a row
    each - are accumulated and joined back.  The range is a function of the key
    alone, so recomputed tasks and both branches of the plan agree on it.  Ties
    need a full order key; nulls come first.  hashed tells that the order begins
    with a 64-bit hash, whose ranges are even and need no sample.

    Every range is a partition, sorted by the order alone and numbered by its
    rows: the sort of a window would compare the range first, which tells no two
    rows of it apart.
    """
    ranges = pieces(df)
    if hashed:
        # the upper 32 bits, from 0
        placed = df.withColumn("__part", F.shiftright((F.shiftright(F.col(order[0]), 32) + (1 << 31)) * ranges, 32).cast("int"))
    else:
        key = F.struct(*[F.col(c) for c in order])
        sample = df.select(key.alias("__k")).orderBy(F.xxhash64("__k"), "__k").limit(16 * ranges)
        bounds = sample.agg(F.filter(F.array_sort(F.collect_list("__k")), lambda _, k: k % 16 == 15).alias("__bounds"))  # one row
        placed = df.crossJoin(F.broadcast(bounds)).withColumn("__key", key)
        placed = _bounds_up_to(placed, "__bounds", "__key", ranges, "__part").drop("__bounds", "__key")
    if weight:
        within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        numbered = placed.withColumn("__at", F.sum(weight).over(within) - F.col(weight))
    else:
        # the lower 33 bits of that id are the row's place in its partition; bounds make one range more than there are bounds
        numbered = placed.repartitionById(ranges + 1, "__part").sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row per range
    return numbered.join(offsets, "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def _bounds_up_to(df: DataFrame, bounds: str, key: str, most: int, name: str) -> DataFrame:
    """df with the number of the (at most `most`) sorted bounds that do not exceed the key, by halving steps in compiled columns."""
    at = F.col(name)
    df = df.withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        fits = (at + step <= F.size(bounds)) & (F.get(F.col(bounds), at + step - 1) <= F.col(key))
        df = df.withColumn(name, F.when(fits, at + step).otherwise(at))
    return df


def time_bounds(n: int, n_folds: int, test_size: int | None = None, gap: int = 0, max_train: int | None = None, rolling: bool = False) -> list[dict[str, int]]:
    """Position bounds [train_start, train_end) and [val_start, val_end) of expanding or rolling folds over n ordered rows."""
    widest = max(1, n // (n_folds + 1))
    size = min(test_size or widest, widest) if rolling else n // (n_folds + 1)
    if size < 1:
        raise ValueError(f"{n} rows are too few for {n_folds} folds")
    longest = (max_train or max(2 * size, int(0.8 * n))) if rolling else n
    out = []
    for k in range(n_folds):
        start = n - (n_folds - k) * size
        end = start - (gap if rolling else 0)
        if end < 1:
            raise ValueError("gap leaves no training rows")
        out.append({"fold": k, "train_start": max(0, end - longest), "train_end": end, "val_start": start, "val_end": start + size})
    return out


def period_rank(df: DataFrame, ts: str, name: str = "__period") -> DataFrame:
    """df with the 0-based rank of its timestamp among distinct ones; periods are few, rows many."""
    periods = df.select(ts).where(F.col(ts).isNotNull()).distinct()
    ranked = positions(periods, [ts], name)
    return df.join(ranked, ts, "left")


def period_count(df: DataFrame, ts: str) -> int:
    return df.agg(F.count_distinct(ts)).first()[0]


def cut_position(n: int, frac: float) -> int:
    """Periods before the cut of a share `frac` at the end; round half to even, at least one on each side."""
    if n < 2:
        raise ValueError("a split needs two periods")
    return min(max(round(n * (1 - frac)), 1), n - 1)


def ts_group_split(df: DataFrame, ts: str, frac: float) -> DataFrame:
    """df with split = train or test, cut between distinct timestamps."""
    cut = cut_position(period_count(df, ts), frac)
    return period_rank(df, ts).withColumn("split", F.when(F.col("__period") < cut, "train").otherwise("test")).drop("__period")


def rolling_period_folds(df: DataFrame, ts: str, n_folds: int) -> DataFrame:
    """(fold, side, and df's columns) of rolling folds over distinct timestamps."""
    bounds = time_bounds(period_count(df, ts), n_folds, rolling=True)
    ranked = period_rank(df, ts)
    sides = [
        ranked.where(F.col("__period").between(b[f"{side}_start"], b[f"{side}_end"] - 1)).select(F.lit(b["fold"]).alias("fold"), F.lit(side).alias("side"), *df.columns)
        for b in bounds for side in ("train", "val")
    ]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out


def walk_forward_folds(df: DataFrame, ts: str, train: int, val: int, test: int, step: int) -> DataFrame:
    """Timestamp bounds of sliding blocks over distinct timestamps: one row per fold."""
    block = train + val + test
    ranked = positions(df.select(ts).where(F.col(ts).isNotNull()).distinct(), [ts], "p")
    n = period_count(df, ts)
    if n < block:
        raise ValueError(f"{n} periods do not hold a block of {block}")
    spark = df.sparkSession
    starts = spark.range(0, n - block + 1, step).select((F.col("id") / step).cast("int").alias("fold_idx"), F.col("id").alias("s"))
    wanted = starts.select("fold_idx", F.explode(F.create_map(*[x for name, at in (("train_start", 0), ("train_max", train - 1), ("val_min", train), ("val_max", train + val - 1), ("test_min", train + val), ("test_max", block - 1)) for x in (F.lit(name), F.col("s") + at)])).alias("bound", "p"))
    names = ["train_start", "train_max", "val_min", "val_max", "test_min", "test_max"]
    return wanted.join(ranked, "p").groupBy("fold_idx").pivot("bound", names).agg(F.first(ts))


def temporal_holdout(df: DataFrame, ts: str, periods: int | None = None, share: float | None = None) -> DataFrame:
    """df with split = test for the last `periods` distinct timestamps (or the share of them, rounded up)."""
    n = period_count(df, ts)
    k = periods if periods is not None else math.ceil(n * share)
    return period_rank(df, ts).withColumn("split", F.when(F.col("__period") >= n - k, "test").otherwise("train")).drop("__period")


def random_holdout(df: DataFrame, key: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split by a hash threshold."""
    u = F.pmod(F.xxhash64(F.lit(seed), *map(F.col, key)), F.lit(1_000_000)) / 1e6
    return df.withColumn("split", F.when(u < share, "test").otherwise("train"))


def selection_split(df: DataFrame, order: list[str], share: float, tail: bool, seed: int = 42, place: str | None = None) -> DataFrame:
    """df with split for model selection: the last rows in order, or the first in hash order; round half to even. place is a column with the hash order's position."""
    n = df.count()
    k = min(max(round(n * share), 1), n - 1)
    if tail:
        return positions(df, order, "__pos").withColumn("split", F.when(F.col("__pos") >= n - k, "val").otherwise("train")).drop("__pos")
    numbered = df if place else hash_place(df, order, seed, "__pos")
    return numbered.withColumn("split", F.when(F.col(place or "__pos") < k, "val").otherwise("train")).drop("__pos")


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """A sample of n rows that is the same for the same key and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *map(F.col, key)), *key).limit(n)


def fold_audit(df: DataFrame, fold: str, ts: str) -> DataFrame:
    """Rows, first and last time of each fold."""
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def side(position: Column, bound: dict[str, int], name: str) -> Column:
    return (position >= bound[f"{name}_start"]) & (position < bound[f"{name}_end"])
