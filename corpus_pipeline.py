"""Corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import code_documents
from lectern.llm.common import cut, drop
from lectern.llm.decontaminate import decontaminated
from lectern.llm.neardup import drop_near_duplicates
from lectern.llm.quality import drop_poor
from lectern.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model learns from this stage's labelled rows. Null and empty texts have the score of the bias alone."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the model learns from this stage's labelled rows. Null and empty texts have the score of the bias alone."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group. Null and empty texts stay; of rows that repeat an id one stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left. Null and empty texts have no tokens."""
    return code_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("neardup", neardup), ("decontamination", decontamination), ("bpe", bpe)]

#: The classifiers and the BPE codec can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that all stages keep.

    Null or empty texts are scored by the models' biases alone, link with nothing, hold no benchmark item and have no
    tokens. A null doc_id passes through every stage. Rows that repeat an id count as one document for near duplicates, so
    one of them stays. An empty table gives no rows. Other columns, whatever their names, pass through up to the last stage.
    A stage's table is deleted once the next one's is written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
