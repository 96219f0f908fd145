"""Filters, fills, encodings and reshaping before and after features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import quantiles_of
from .cleanup import finite


def positive_target(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & (F.col(y) > 0))


def alive(start: Column, end: Column, listed: str = "listed_at", delisted: str = "delisted_at") -> Column:
    """Whether a listing overlaps [start, end]; null bounds are open."""
    return (F.col(listed).isNull() | (F.col(listed) <= end)) & (F.col(delisted).isNull() | (F.col(delisted) >= start))


def requested(request: DataFrame, universe: DataFrame, start: Column, end: Column, key: str = "ticker") -> DataFrame:
    """Every requested key with the reason it cannot be used, or null."""
    right = universe.dropDuplicates([key]).withColumn("__there", F.lit(True))
    reason = F.when(~F.col(key).rlike("^[A-Z0-9.-]+$"), "bad syntax").when(F.col("__there").isNull(), "unknown").when(F.col("listed_at") > end, "not listed yet").when(F.col("delisted_at") < start, "delisted before")
    return request.join(right, key, "left").select(key, reason.alias("reason"))


def utc(c: Column, zone: str = "America/New_York") -> Column:
    return F.to_utc_timestamp(c, zone)


def pruned_columns(df: DataFrame, max_missing: float = 0.2, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns mostly missing or with at most one value; fitted on training rows, dropped everywhere."""
    names = [c for c in df.columns if c not in exclude]
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[x for k, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{k}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{k}"))]).first()
    n = row["__n"]
    return [c for k, c in enumerate(names) if n and (1 - row[f"n{k}"] / n > max_missing or row[f"d{k}"] <= 1)]


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, unreadable values null."""
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def complete_rows(df: DataFrame, columns: list[str], at_least: int | None = None) -> DataFrame:
    return finite(df, columns).na.drop(subset=columns) if at_least is None else df.na.drop(subset=columns, thresh=at_least)


def decimal_comma(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(c), r"\.", ""), ",", ".").try_cast("double").alias(c)


def vocabulary(train: DataFrame, column: str) -> DataFrame:
    """(value, code) of the training values in order."""
    values = train.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    from .folds import positions

    return positions(values, ["value"], "code").select("value", F.col("code").cast("long").alias("code"))


def encoded(df: DataFrame, column: str, codes: DataFrame, name: str | None = None) -> DataFrame:
    """df with the ordinal code of a column; values the training rows lack become null."""
    right = codes.select(F.col("value").alias("__value"), F.col("code").alias(name or f"{column}_code"))
    return df.join(right, F.col(column).cast("string") == F.col("__value"), "left").drop("__value")


def unseen(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Rows per value that the training rows lack."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL")
    return values.join(codes, "value", "left_anti").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def fill_median(df: DataFrame, columns: list[str], by_rows_of: DataFrame | None = None) -> DataFrame:
    """Nulls as the exact median of all rows (or of the rows of another frame)."""
    rows = by_rows_of if by_rows_of is not None else df
    found = {c: quantiles_of(rows, [], c, (0.5,)).first() for c in columns}
    row = {c: x and x["__p"][0] for c, x in found.items()}
    return df.select(*[F.coalesce(F.col(c), F.lit(row[c])).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def fill_unknown(c: str, word: str = "unknown") -> Column:
    """Null and blank text as a word."""
    return F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(word)).otherwise(F.col(c)).alias(c)


def in_window(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    return df.where(F.col(ts).between(start, end))


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = [c for c in a.columns if c in set(b.columns)]
    return a.select(*names), b.select(*names)


def first_of(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def date_parts(c: str) -> list[Column]:
    d = F.col(c)
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.weekofyear(d).alias("week")]


def by_state(state: str, flags: dict[str, str]) -> Column:
    """The flag column that belongs to a row's state, 0 elsewhere."""
    out = F.lit(None)
    first = True
    for value, column in flags.items():
        out = F.when(F.col(state) == value, F.col(column)) if first else out.when(F.col(state) == value, F.col(column))
        first = False
    return out.otherwise(F.lit(0))


def typical_price(df: DataFrame) -> DataFrame:
    """hlc_average where it is not there yet."""
    return df if "hlc_average" in df.columns else df.withColumn("hlc_average", (F.col("high") + F.col("low") + F.col("close")) / 3)


def star(fact: DataFrame, dims: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """fact joined to dimensions (frame, keys, join kind) in turn."""
    return reduce(lambda f, d: f.join(d[0], d[1], d[2]), dims, fact)


def common_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with only the rows whose key the other has as well."""
    return left.join(right.select(*keys), keys, "left_semi"), right.join(left.select(*keys), keys, "left_semi")
