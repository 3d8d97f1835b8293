"""Traces on disk, payload slices, media variants, episodes in Parquet, synthetic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Variants of a stream's video by preference; depth has no lossy one.
VARIANTS = {"RGB_IMAGES": ("lossless", "lossy"), "DEPTH_IMAGES": ("lossless",)}


def write_traces(samples: DataFrame, path: str, order: str = "ts_us") -> None:
    """JSON lines by recording and data type, in order of time within a file.

    Range partitioning by stream and time keeps files of like size, whatever a
    stream's length.
    """
    own = samples.repartitionByRange("recording_id", "data_type", order).sortWithinPartitions("recording_id", "data_type", order)
    own.write.mode("overwrite").partitionBy("recording_id", "data_type").json(path)


def json_array_traces(samples: DataFrame, by: list[str], order: str) -> DataFrame:
    """One JSON array a trace, compact, its frames in order."""
    payload = [c for c in samples.columns if c not in by]
    frames = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.to_json(F.struct(*payload)).alias("frame"))))
    return samples.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(F.transform(frames, lambda s: s["frame"]), ","), F.lit("]")).alias("trace"))


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Traces as `write_traces` left them; columns in the order of ``schema``."""
    df = spark.read.schema(schema).json(path)
    return df.select(*(c.strip().split()[0] for c in schema.split(",")))


def payload_slices(index: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """Slices (offset, length, frame_idx) of each trace's payload; frame_idx defaults to the position."""
    at = F.coalesce("frame_idx", "position")
    return index.join(blobs, key).select(key, at.alias("frame_idx"), F.substring(F.col("blob"), F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("payload"))


def best_variant(files: DataFrame, by: list[str]) -> DataFrame:
    """The preferred variant of each stream's files (path, variant); unsuited ones are left out."""
    rank: Column = F.lit(None).cast("int")
    for kind, order in VARIANTS.items():
        for k, v in enumerate(order):
            rank = F.when((F.col("data_type") == kind) & (F.col("variant") == v), F.lit(k)).otherwise(rank)
    ranked = files.withColumn("rank", rank).where("rank is not null")
    return ranked.groupBy(*by, "data_type").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def payloads_by_frame(synced: DataFrame, frames: DataFrame) -> DataFrame:
    """Attaches payloads last, by (recording_id, sensor, frame_idx), after all pruning."""
    return synced.join(frames, ["recording_id", "sensor", "frame_idx"], "left")


def read_episodes(spark: SparkSession, path: str, episodes: list[int] | None = None) -> DataFrame:
    """Frames of a dataset in Parquet, by episode and frame; the filter reaches the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("episode_index").isin(episodes)) if episodes is not None else df
    return df.orderBy("episode_index", "frame_index")


def episode_ids(frames: DataFrame) -> DataFrame:
    return frames.select("episode_index").distinct().orderBy("episode_index")


def synthetic(spark: SparkSession, n: int, robots: int, sensors: list[str], seed: int = 0) -> DataFrame:
    """Random samples of every sensor for ``n`` recordings, dealt to the robots in turn."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "id", "sensor")), 1, 8), 16, 10).cast("long")
    own = spark.range(n).withColumn("sensor", F.explode(F.array(*map(F.lit, sensors))))
    return own.select(F.col("id").alias("recording_id"), (F.col("id") % robots).alias("robot_id"), "sensor", (u % 1_000_000 / 1_000_000).alias("value"))
