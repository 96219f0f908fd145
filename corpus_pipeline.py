"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Defined cases of every stage: a null text is empty (and fails the quality rules);
extra columns pass through, whatever their names; an empty table stays empty.
Rows are told apart by doc_id and a hash of the text, so a row without an id, or
with another row's, has verdicts of its own; of rows that agree in both, verdicts
agree, and near_dedup keeps one.  Texts of any length are judged, changed and
packed whole; memory is that of a few arrays for each character of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import staged, table
from ctxloom.llm.divergence import judge_quality
from ctxloom.llm.importance import select_by_importance
from ctxloom.llm.minhash import near_duplicates
from ctxloom.llm.packing import pack_documents
from ctxloom.llm.queries import WORD_BPE, secret_vocabulary, vocabulary
from ctxloom.llm.secrets import redact_secrets


#: names that no table of documents has
KEY = "_ctxloom_text_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("text"))


def _chosen(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs (with KEY) whose verdict is kept."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col(KEY).alias("_kept_key")).distinct()
    return docs.join(kept, (F.col(KEY) == F.col("_kept_key")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi").drop(KEY)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; without labelled good rows, all."""
    docs = _keyed(docs)
    return _chosen(docs, select_by_importance(docs, table(spark, sf_dir, "labels"), carry=(KEY,)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near their language's histograms."""
    docs = _keyed(docs)
    return _chosen(docs, judge_quality(docs, carry=(KEY,)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, or any where none has an id."""
    docs = _keyed(docs)
    verdicts = staged(near_duplicates(docs, carry=(KEY,)), "verdicts")
    kept = _chosen(docs.withColumn("_again", F.col(KEY)), verdicts).withColumnRenamed("_again", KEY)
    repeated = staged(verdicts.where("n_shingles > 0").groupBy("doc_id", KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), F.col(KEY).alias("_key")), "repeated", 1)
    if repeated.isEmpty():
        return kept.drop(KEY)
    same = (F.col(KEY) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", KEY]).unionByName(kept.join(repeated, same, "left_anti")).drop(KEY)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    return redact_secrets(docs, secret_vocabulary())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary(WORD_BPE), 1, 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Vocabularies and hashed models have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
