"""Text scores: a lexicon scorer in SQL expressions, content keys, cached scoring."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A small lexicon; the last word of each occurs in the invented prose of the test tables.
POSITIVE = ("gain", "growth", "beat", "strong", "rise", "profit", "record", "good", "the")
NEGATIVE = ("loss", "fall", "miss", "weak", "drop", "risk", "fraud", "bad", "of")


def lexicon_score(text: Column) -> Column:
    """struct(pos, neg, neu, score): shares of lexicon words with one neutral pseudo-word; score = pos - neg."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    count = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(*lexicon))).cast("double")
    pos, neg = count(POSITIVE), count(NEGATIVE)
    total = pos + neg + 1
    return F.struct((pos / total).alias("pos"), (neg / total).alias("neg"), (1 / total).alias("neu"), ((pos - neg) / total).alias("score"))


class Scorer(Protocol):
    """What a model needs to offer: a name, a revision, and scores of a batch of texts."""

    name: str
    revision: str

    def scores(self, texts: list[str]) -> list[tuple[float, float, float]]:
        """(pos, neg, neu) of each text, adding up to 1."""
        ...


class LexiconScorer:
    name, revision = "lexicon", "1"

    def scores(self, texts: list[str]) -> list[tuple[float, float, float]]:
        import re

        out = []
        for t in texts:
            words = re.findall("[a-z]+", (t or "").lower())
            pos, neg = sum(w in POSITIVE for w in words), sum(w in NEGATIVE for w in words)
            out.append((pos / (pos + neg + 1), neg / (pos + neg + 1), 1 / (pos + neg + 1)))
        return out


def score_with(scorer: Scorer, text: Column) -> Column:
    """The scorer as a batched function of a text column; one instance per worker."""

    @F.pandas_udf("pos double, neg double, neu double, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame(scorer.scores(texts.tolist()), columns=["pos", "neg", "neu"])
            yield out.assign(score=out.pos - out.neg)

    return run(text)


def article_key(text: Column, model: Column, revision: Column) -> Column:
    """SHA-256 over the parts, each after its length in 8 bytes, so borders cannot shift."""
    part = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), F.encode(c, "UTF-8"))
    return F.sha2(F.concat(*[part(F.coalesce(c, F.lit(""))) for c in (text, model, revision)]), 256)


def score_cached(articles: DataFrame, cache: DataFrame, scorer: Scorer, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(articles with scores, rows new to the cache): only texts whose key the cache lacks are scored, once each."""
    key = article_key(F.col(text), F.lit(scorer.name), F.lit(scorer.revision))
    keyed = articles.withColumn("article_key", key)
    missing = keyed.select("article_key", text).dropDuplicates(["article_key"]).join(cache, "article_key", "left_anti")
    fresh = missing.select("article_key", F.lit(scorer.name).alias("model_name"), F.lit(scorer.revision).alias("model_revision"), score_with(scorer, F.col(text)).alias("s")).select("article_key", "model_name", "model_revision", "s.*")
    known = cache.select(*fresh.columns).unionByName(fresh)
    return keyed.join(known, "article_key", "left"), fresh
