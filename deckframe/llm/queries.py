"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.llm import ann, chat, mixing, neardup, quality, secrets, sentencepiece_fst, sharding, token_counts, urls

URL_RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), ratio=1.5, cap=2)
    return mixing.decisions(mix)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.labelled(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"), "votes")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sharding.new_map(spark)
    placed, _ = sharding.shard(_read(spark, sf_dir, "documents"), 8, map_path=path)
    return sharding.with_next(placed, path)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.attack(_read(spark, sf_dir, "conversations"))
    out = chat.digests(rows, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_token_counts": op6_token_counts,
    "op7_urls": op7_urls,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_ann": op10_ann,
}
