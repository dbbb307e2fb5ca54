"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import code_documents
from .decontaminate import contaminated
from .hamming import ORACLE as HAMMING_SQL
from .hamming import search
from .hardneg import ORACLE as HARD_NEGATIVES_SQL
from .hardneg import hard_negatives
from .langid import identify_languages
from .merkle import ORACLE as MERKLE_SQL
from .merkle import merkle_manifest
from .neardup import near_duplicates
from .quality import score_quality
from .sharding import ORACLE as SHARDING_SQL
from .sharding import shard
from .suffixdedup import without_repeats
from .tokenfile import token_files
from .toxicity import score_toxicity
from .warc import ORACLE as WARC_SQL
from .warc import archive_pages

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).drop("digest_ok")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_hamming_topk": op2_hamming_topk,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": SHARDING_SQL,
    "op2_hamming_topk": HAMMING_SQL,
    "op6_warc": WARC_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_merkle_manifest": MERKLE_SQL,
}
