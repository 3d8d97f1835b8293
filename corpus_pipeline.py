"""A training corpus from raw documents: score, deduplicate, redact, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import mixing, packing, quality, secrets, simhash
from kelpline.llm.common import bound_batches, materialise, table
from kelpline.llm.queries import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; each row is judged by its own text."""
    bound_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    bound_batches(spark)
    return simhash.deduplicate(docs, similarity=0.8, words=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced; every document stays."""
    return secrets.redact(docs, secrets.forest(spark, tokenizer_path()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as their sources' targets ask, in training order."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
