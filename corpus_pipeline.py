"""Documents to token ids: language ID, near-duplicate removal, secret redaction, source mixing, SentencePiece ids.

Defined results: null texts, blank ones and those without a letter have no language and go. Null sources and languages are values like any
other. Rows with null ids are rows like any other, but near copies go, and of equal rows one stays. The words of rows with one id are
counted together when copies are made. Further columns pass through all stages, whatever their names; only ``text`` becomes
``piece_ids`` at the end. Very long texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import langid, mixing, pieces, secrets, simhash
from tallyforge.llm.common import materialize, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return langid.keep_known(docs, langid.fit(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become arrays of piece ids."""
    return pieces.encode(docs).drop("text")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_redaction),
    ("source_mix", source_mix),
    ("sentencepiece", token_ids),
]

#: Neural language ID and fingerprints' components have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)  # nothing reads it any more
        before = docs
    return docs
