"""The driver's queries of this subpackage: each applies one operator, with production parameters,
to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, language, media, minhash, packing, sharding, substring_dedup, suffix_dedup, token_files, vamana

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.train(docs, PIECES)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digests(common.table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), WORD_BPE)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op6_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(common.table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.Scratch(spark, "token-files").path("out")
    token_files.write(common.table(spark, sf_dir, "documents"), root, BYTE_BPE, end_id=2)
    return token_files.read(spark, root)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(common.table(spark, sf_dir, "documents"), WORD_BPE)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_language_id, op3_media, op4_packing, op5_suffix_dedup, op6_vamana, op7_token_files, op8_bpe, op9_substring_dedup, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    return {}
