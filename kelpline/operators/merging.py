"""Last-writer-wins merging of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_points(points: DataFrame) -> DataFrame:
    """Merges points (arg, point_us, data_type, label, value): the latest value of each label.

    A point's own time decides, and the later argument among equal times.
    Adds the merged time: the latest of all points.
    """
    latest = points.groupBy("data_type", "label").agg(F.max_by(F.struct("value"), F.struct("point_us", "arg")).getField("value").alias("value"))
    return latest.join(F.broadcast(points.agg(F.max("point_us").alias("merged_us"))))


def latest_per_stream(samples: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each stream; combines map-side."""
    best = samples.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s"))
    return best.select(*by, "s.*")


def availability(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Tracks present after upserts and removals (event = 'add' or 'remove')."""
    return latest_per_stream(events, by, order, ["event"]).where("event = 'add'").drop("event")


def coalesced_status(reports: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One status a key: the last reported bytes; completion sticks."""
    return reports.groupBy(key).agg(F.max_by("bytes", F.struct(*order)).alias("bytes"), F.bool_or("completed").alias("completed"))


def fold_states(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Final status of a row under guarded updates (kind, bytes).

    ``fail`` counts unless the row was written before; ``written`` counts
    unless it failed before: the first of the two decides. Progress keeps the
    last bytes before that.
    """
    at = F.struct(*order)
    final = updates.where(F.col("kind").isin("written", "fail")).groupBy(key).agg(F.min_by("kind", at).alias("final"), F.min(at).alias("since"))
    open_ = updates.join(final, key, "left").where(F.col("since").isNull() | (at <= F.col("since")))
    return open_.groupBy(key).agg(
        F.when(F.first("final") == "written", "written").when(F.first("final") == "fail", "failed").otherwise("writing").alias("status"), F.max_by("bytes", at).alias("bytes"),
    )


def stamped_first(updates: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """First non-null value of each column: a stamp, once set, stays."""
    return updates.groupBy(key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns))
