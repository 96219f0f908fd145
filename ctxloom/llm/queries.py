"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Vocabulary files; a parameter of the operators, never part of this repository.
BYTE_BPE, WORD_BPE, PIECE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces, piece_digests

    model = vocabulary(PIECE_BPE)
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), model), model)


def op2_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import token_digests, write_token_files

    return token_digests(write_token_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), 2))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import select_by_importance

    return select_by_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), 1, 2048)


def secret_vocabulary():
    import public_tokenizers

    from .secrets import Vocabulary

    return Vocabulary(vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)


def op8_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, secret_digests

    return secret_digests(find_secrets(table(spark, sf_dir, "documents"), secret_vocabulary()))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .progressive import media_digests, stored_media

    return media_digests(stored_media(table(spark, sf_dir, "documents")))


def op10_block_tree_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mainhtml import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .urls import ORACLE

    return {"op4_blocked_bloom_urls": ORACLE}
