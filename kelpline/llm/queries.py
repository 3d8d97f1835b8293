"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import chat, licenses, media, mixing, packing, quality, secrets, simhash, topk, urls
from kelpline.llm.common import table


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary; KELPLINE_TOKENIZER names another file."""
    if own := os.environ.get("KELPLINE_TOKENIZER"):
        return own
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.plain_outcome(F.col("html")))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.forest(spark, tokenizer_path()))
    return found.select("doc_id", "word_index", "kind", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digests(turns.unionByName(own))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_simhash_near_dedup, op3_quality_classifier, op4_media_columns, op5_mixing_sources,
        op6_url_filters, op7_secret_scans, op8_exact_top_k, op9_license_scans, op10_chat_formatting,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing_sources": mixing.SQL,
    "op6_url_filters": urls.SQL,
    "op8_exact_top_k": topk.SQL,
}
