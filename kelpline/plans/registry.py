"""Where queries and their SQL are registered, and the tables seen as sensor data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: recording_id, sensor, ts_us, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("sensor"), micros(F.col("ts")).alias("ts_us"), "value")


#: The same in SQL, for the start of a WITH clause.
SAMPLES_SQL = "samples AS (SELECT user_id AS recording_id, event_type AS sensor, epoch_us(ts) AS ts_us, value FROM events)"
