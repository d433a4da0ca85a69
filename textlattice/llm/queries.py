"""The registered queries of the training-data operators, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fmindex, language, minhash, packing, pii, quality, sharding, sql, suffixes, toxicity
from .common import crc_remainder, table

SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeated_words(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_remainder("doc_id", 3) != 1), "lang", "doc_id", "text")
    return language.identify(docs, model)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(table(spark, sf_dir, "documents"), SHARD_NAMES).select("doc_id", F.col("slot"), "shard")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_personal_data, op2_toxicity, op3_near_duplicates, op4_substring_dedup, op5_language, op6_suffix_dedup, op7_decontamination, op8_sharding, op9_quality, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": sql.NEAR_DUPLICATES, "op4_substring_dedup": sql.SUBSTRING_DEDUP, "op6_suffix_dedup": sql.SUFFIX_DEDUP}
