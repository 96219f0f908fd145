"""Small dense statistics from one distributed pass: correlations, Gram matrices, Student's t."""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def correlations(df: DataFrame, left: list[str], right: list[str]) -> dict[tuple[str, str], float | None]:
    """Pairwise Pearson correlations in one aggregation; nulls are skipped pair by pair."""
    pairs = [(a, b) for a in left for b in right]
    if not pairs:
        return {}
    row = df.agg(*[_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    return {p: None if row[k] is None or math.isnan(row[k]) else row[k] for k, p in enumerate(pairs)}


def _corr(a: Column, b: Column) -> Column:
    return F.corr(a, b)


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> np.ndarray:
    """Symmetric matrix with NaN where undefined; spearman ranks columns first (average ranks)."""
    if method == "spearman":
        df = _ranked(df, columns)
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    out = np.eye(n)
    if pairs:
        row = df.agg(*[_corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
        for k, (i, j) in enumerate(pairs):
            out[i, j] = out[j, i] = np.nan if row[k] is None else row[k]
    return out


def _ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as average ranks: distinct values are counted, placed by the counts before them, and joined back."""
    from .folds import positions

    out = df.select(*columns)
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        placed = positions(counts, ["__value"], "__below", "__n")
        ranks = placed.select("__value", (F.col("__below") + (F.col("__n") + 1) / 2).alias("__rank"))
        out = out.join(ranks, F.col(c) == F.col("__value"), "left").withColumn(c, F.col("__rank")).drop("__value", "__rank")
    return out


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of products, sums, rows) over complete columns, in one aggregation."""
    n = len(columns)
    c = [F.col(x).cast("double") for x in columns]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(x) for x in c], *[F.sum(c[i] * c[j]) for i, j in pairs]).first()
    out = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[1 + n + k] or 0.0
    return out, np.array([row[1 + k] or 0.0 for k in range(n)]), row[0]


@dataclass
class Moments:
    """Rows, values of each column, means, and summed products of deviations; the latter of complete columns alone make sense."""

    columns: list[str]
    n: int
    values: np.ndarray
    means: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        """The moments of both sets of rows."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.means - self.means
        return Moments(self.columns, n, self.values + other.values, self.means + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


def moment_columns(columns: list[str]) -> list[Column]:
    """What moments() reads: rows, values and means of each column, and deviations of each pair."""
    c, n = [F.col(x).cast("double") for x in columns], len(columns)
    apart = [F.var_pop(c[i]) if i == j else F.covar_pop(c[i], c[j]) for i in range(n) for j in range(i, n)]
    return [F.count(F.lit(1)), *[F.count(x) for x in c], *[F.avg(x) for x in c], *apart]


@contextmanager
def _compiled(spark: SparkSession, fields: int):
    """While in use, Spark compiles aggregations that hold this many numbers a group; it interprets those above 100, at several times the cost."""
    name = "spark.sql.codegen.maxFields"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), fields)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _moments(columns: list[str], row: tuple) -> Moments:
    """Moments from a row of moment_columns()."""
    n = len(columns)
    products = np.zeros((n, n))
    for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n)):
        products[i, j] = products[j, i] = (row[1 + 2 * n + k] or 0.0) * row[0]
    return Moments(columns, row[0], np.array(row[1 : n + 1], dtype=float), np.array([x or 0.0 for x in row[n + 1 : 2 * n + 1]]), products)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Moments of columns in one aggregation, by running means rather than sums of squares."""
    n = len(columns)
    with _compiled(df.sparkSession, 2 * n * (n + 3)):
        return _moments(columns, df.agg(*moment_columns(columns)).first())


def moments_by(df: DataFrame, by: str, values: list, columns: list[str]) -> list[Moments]:
    """Moments of the rows of each value of a column of few values, in one aggregation."""
    n = len(columns)
    with _compiled(df.sparkSession, 2 * n * (n + 3)):
        rows = df.where(F.col(by).isin(values)).groupBy(by).agg(*moment_columns(columns)).collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    return [_moments(columns, found.get(v, (0,) * (1 + n) + (None,) * (n + n * (n + 1) // 2))) for v in values]


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if math.isnan(t) or dof <= 0:
        return math.nan
    return beta_fraction(dof / 2, 0.5, dof / (dof + t * t))
