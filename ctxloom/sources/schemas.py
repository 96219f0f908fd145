"""Fixed schemas of the panel tables, and checks that give violations as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.guards import prob_sum_violations, repeated_keys

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()


def _struct(**fields: tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(k, t, nullable) for k, (t, nullable) in fields.items()])


PRICES = _struct(ticker=(_S, False), period_close_ts=(_TS, False), open=(_D, True), high=(_D, True), low=(_D, True), close=(_D, True), adj_close=(_D, True), volume=(_D, True), hlc_average=(_D, True))
ARTICLES = _struct(ticker=(_S, False), published_at=(_TS, False), text=(_S, True), source=(_S, False))
ARTICLE_SCORES = _struct(article_key=(_S, False), model_name=(_S, False), model_revision=(_S, False), pos=(_D, False), neg=(_D, False), neu=(_D, False), score=(_D, False))
PERIOD_SENTIMENT = _struct(ticker=(_S, False), period_close_ts=(_TS, False), sentiment_score=(_D, False), sentiment_pos=(_D, False), sentiment_neg=(_D, False), sentiment_neu=(_D, False), n_articles=(_L, False))
MARKET_SENTIMENT = T.StructType([f for f in PERIOD_SENTIMENT if f.name != "ticker"])

KEYS = {"prices": ("ticker", "period_close_ts"), "articles": ("ticker", "published_at", "source"), "article_scores": ("article_key", "model_name", "model_revision"), "period_sentiment": ("ticker", "period_close_ts"), "market_sentiment": ("period_close_ts",)}
SCHEMAS = {"prices": PRICES, "articles": ARTICLES, "article_scores": ARTICLE_SCORES, "period_sentiment": PERIOD_SENTIMENT, "market_sentiment": MARKET_SENTIMENT}


@dataclass
class Validation:
    problems: list[str]  # of the schema
    nulls: DataFrame | None  # rows with nulls where none may be
    repeated: DataFrame | None  # keys that occur more than once
    bad_sums: DataFrame | None  # rows whose shares do not add up

    @property
    def passed(self) -> bool:
        return not self.problems and all(d is None or d.isEmpty() for d in (self.nulls, self.repeated, self.bad_sums))


def validate(df: DataFrame, table: str) -> Validation:
    """Strict: exactly the columns of the schema, with its types; then nulls, key repeats and share sums as rows."""
    want = {f.name: f for f in SCHEMAS[table]}
    have = {f.name: f.dataType for f in df.schema}
    problems = [f"missing {c}" for c in want if c not in have] + [f"unexpected {c}" for c in have if c not in want]
    problems += [f"{c} is {have[c].simpleString()}, not {f.dataType.simpleString()}" for c, f in want.items() if c in have and have[c] != f.dataType]
    if problems:
        return Validation(problems, None, None, None)
    required = [c for c, f in want.items() if not f.nullable]
    nulls = df.where(" OR ".join(f"{c} IS NULL" for c in required))
    parts = tuple(c for c in ("pos", "neg", "neu", "sentiment_pos", "sentiment_neg", "sentiment_neu") if c in want)
    return Validation([], nulls, repeated_keys(df, list(KEYS[table])), prob_sum_violations(df, parts) if parts else None)
