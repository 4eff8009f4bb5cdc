"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import decontamination, divergence, fingerprints, fixity, grayindex, jaccard, language, manifest, packing, pii, secrets, sharding, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op7_decontaminate"] = op7_decontaminate
ORACLES["op7_decontaminate"] = decontamination.ORACLE


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_table(_table(spark, sf_dir, "documents"), packing.word_tokenizer_path())


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return fixity.fixity_report(pages, fixity.damaged_replica(pages))


QUERIES |= {"op1_best_fit_packing": op1_best_fit_packing, "op6_kd_sharding": op6_kd_sharding, "op10_merkle_audit": op10_merkle_audit}
ORACLES["op10_merkle_audit"] = fixity.ORACLE


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(_table(spark, sf_dir, "documents"))


QUERIES["op2_language_id"] = op2_language_id


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.simhash_report(_table(spark, sf_dir, "documents"))


QUERIES["op5_simhash"] = op5_simhash


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


QUERIES["op3_ngram_jaccard"] = op3_ngram_jaccard
ORACLES["op3_ngram_jaccard"] = jaccard.ORACLE


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_table(spark, sf_dir, "documents"))


QUERIES["op4_suffix_dedup"] = op4_suffix_dedup


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


QUERIES["op8_secret_scan"] = op8_secret_scan


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


QUERIES["op9_pii_crf"] = op9_pii_crf


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_report(_table(spark, sf_dir, "documents"))


QUERIES["op13_merkle_manifest"] = op13_merkle_manifest
ORACLES["op13_merkle_manifest"] = manifest.ORACLE


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES["op11_source_divergence"] = op11_source_divergence
ORACLES["op11_source_divergence"] = divergence.ORACLE


def op12_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grayindex.simhash_classes(_table(spark, sf_dir, "documents"))


QUERIES["op12_gray_simhash"] = op12_gray_simhash
