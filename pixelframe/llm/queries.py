"""Queries of the text operators with production parameters, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_blocks, manifest, minhash, mixing, negatives, oracles, packing, quality, sentencepieces, spotsigs, suffixes, urls, wordpieces
from .common import table

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(chats))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.count_pieces(table(spark, sf_dir, "documents"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame(mixing.TARGETS, "dimension string, value string, share double")
    return mixing.mix(table(spark, sf_dir, "documents"), targets)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return negatives.mine(negatives.integer_vectors(rows), F.col("vec_id") % 50 == 0)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_url_filter,
        op2_chat_format,
        op3_spotsigs,
        op4_token_counts,
        op5_html_blocks,
        op6_suffix_dedup,
        op7_quality_rules,
        op8_minhash_near_dedup,
        op9_best_fit_packing,
        op10_source_mixing,
        op11_merkle_manifest,
        op12_hard_negatives,
        op13_sentencepiece,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": oracles.URLS,
        "op2_chat_format": oracles.CHATS,
        "op7_quality_rules": oracles.QUALITY,
        "op8_minhash_near_dedup": oracles.NEAR,
        "op11_merkle_manifest": oracles.MANIFEST,
        "op12_hard_negatives": oracles.NEGATIVES,
    }
