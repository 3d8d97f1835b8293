"""Lifecycle queries over recordings and their traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reclaimable(recordings: DataFrame, traces: DataFrame, key: str, expected: str, done: str) -> DataFrame:
    """Recordings with a settled trace, none unsettled, and as many traces as expected.

    ``done``: the traces' boolean column. One aggregation of the traces serves
    all three conditions.
    """
    seen = traces.groupBy(key).agg(F.count(F.lit(1)).alias("n_traces"), F.bool_and(F.col(done)).alias("all_done"))
    return recordings.join(seen, key).where(F.col("all_done") & (F.col("n_traces") == F.col(expected))).drop("n_traces", "all_done")


def pending_progress(recordings: DataFrame) -> DataFrame:
    """Stopped, not cancelled, with a cloud id, and unreported or counted anew."""
    unreported = (~F.col("progress_reported")) | F.col("expected_traces_reported").isNull() | (F.col("expected_traces_reported") != F.col("expected_traces"))
    return recordings.where(F.col("stopped_at").isNotNull() & F.col("cancelled_at").isNull() & F.col("recording_id").isNotNull() & unreported)


def claim_oldest(rows: DataFrame, updated: str, tie: str, most: int, now: int, least_age: int) -> DataFrame:
    """The ``most`` oldest ready rows, once there are that many or the oldest is old enough."""
    oldest = rows.orderBy(updated, tie).limit(most)
    seen = rows.agg(F.count(F.lit(1)).alias("ready"), F.min(updated).alias("oldest"))
    due = (F.col("ready") >= most) | (F.lit(now) - F.col("oldest") >= least_age)
    return oldest.join(F.broadcast(seen)).where(due).drop("ready", "oldest")


def claim_retries(rows: DataFrame, attempts: str, most_attempts: int, updated: str, before: int, tie: str, most: int) -> DataFrame:
    """Failed rows to try again: few enough attempts, untouched since a time, oldest first."""
    return rows.where((F.col(attempts) < most_attempts) & (F.col(updated) < before)).orderBy(updated, tie).limit(most)


def latest_match(rows: DataFrame, condition, order: str) -> DataFrame:
    return rows.where(condition).orderBy(F.desc(order)).limit(1)


def promoted(traces: DataFrame) -> DataFrame:
    """Upload becomes pending where a trace is registered and written and nothing has begun."""
    ready = (F.col("registration_status") == "registered") & (F.col("write_status") == "written") & F.col("upload_status").isNull()
    return traces.withColumn("upload_status", F.when(ready, "pending").otherwise(F.col("upload_status")))


def reset_after_crash(traces: DataFrame) -> DataFrame:
    """What was in progress is pending again."""
    again = lambda c, doing, waiting: F.when(F.col(c) == doing, waiting).otherwise(F.col(c))
    return traces.withColumns({"registration_status": again("registration_status", "registering", "pending"), "upload_status": again("upload_status", "uploading", "pending")})


def cascade_delete(recordings: DataFrame, traces: DataFrame, key: str, gone) -> tuple[DataFrame, DataFrame]:
    """Both tables without the recordings that ``gone`` names."""
    kept = recordings.where(~F.coalesce(gone, F.lit(False)))
    return kept, traces.join(kept.select(key), key, "left_semi")


def inserted_once(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds the rows whose key is new; of several with the same key, one."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"))


def compare_and_set(rows: DataFrame, column: str, expected, value) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column).eqNullSafe(expected), value).otherwise(F.col(column)))
