"""Datasets of recordings: lookup, merging, cloning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(datasets: DataFrame, column: str, value, missing_ok: bool = False) -> DataFrame:
    """The rows with a value; LookupError if there are none."""
    found = datasets.where(F.col(column) == F.lit(value))
    if not missing_ok and found.isEmpty():
        raise LookupError(f"no dataset with {column} {value!r}")
    return found


def merged(*recordings: DataFrame, key: str = "recording_id") -> DataFrame:
    """All recordings of several datasets, each once."""
    out = recordings[0]
    for other in recordings[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates([key])


def cloned(recordings: DataFrame, dataset_id: str) -> DataFrame:
    return recordings.withColumn("dataset_id", F.lit(dataset_id))


def page(recordings: DataFrame, key: str, after, size: int = 30) -> DataFrame:
    """The next ``size`` recordings in order of key."""
    later = recordings if after is None else recordings.where(F.col(key) > F.lit(after))
    return later.orderBy(key).limit(size)


def evictable(files: DataFrame, share: float, age: str = "used_at", locked: str = "locked") -> DataFrame:
    """The least recently used ``share`` of the files that aren't locked, at least one."""
    free = files.where(~F.col(locked))
    most = max(1, int(free.count() * share))
    return free.orderBy(age, "path").limit(most)
