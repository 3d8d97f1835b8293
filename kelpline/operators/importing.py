"""Configured import: topics, paths, slices, clocks, resumption and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mappings(items: list[dict]) -> list[dict]:
    """(topic, path, name, data_type) of configured items.

    An absolute item (``/topic.field.field``) names its own topic; a relative
    one needs a ``source``.
    """
    out = []
    for item in items:
        path, source = item["source_name"], item.get("source")
        if path.startswith("/"):
            topic, _, rest = path.partition(".")
        elif source:
            topic, rest = source, path
        else:
            raise ValueError(f"{path!r} is relative and has no source")
        out.append({"topic": topic, "path": [p for p in rest.split(".") if p], "name": item.get("name", path), "data_type": item.get("data_type")})
    return out


def fan_out(messages: DataFrame, mapping: DataFrame, on: str = "topic") -> DataFrame:
    """A row for each mapping of a message's topic; unknown topics have none.

    The mapping is a configuration: broadcast if it is as small as one.
    """
    return messages.join(mapping, on)


def json_path(column: Column, path: list[str | int]) -> Column:
    """The value at a path of keys and indexes in a JSON text, as text."""
    steps = "".join(f"[{p}]" if isinstance(p, int) or str(p).isdigit() else f".{p}" for p in path)
    return F.get_json_object(column, "$" + steps)


def sliced(array: Column, start: int, end: int) -> Column:
    """Elements [start, end) of an array."""
    return F.slice(array, start + 1, end - start)


def split_pose(array: Column, position: tuple[int, int] | None, orientation: tuple[int, int] | None) -> Column:
    """Position and orientation ranges of an array, joined; both or neither."""
    if (position is None) != (orientation is None):
        raise ValueError("position and orientation ranges go together")
    return array if position is None else F.concat(sliced(array, *position), sliced(array, *orientation))


def resolved_time(log_ns: Column, publish_ns: Column) -> Column:
    """Seconds: the log's time, else the publisher's, else now."""
    ns = F.coalesce(F.when(log_ns > 0, log_ns), F.when(publish_ns > 0, publish_ns))
    return F.coalesce(ns / 1e9, F.unix_micros(F.current_timestamp()) / 1e6)


def topic_estimate(channels: DataFrame, topics: list[str], topic: str = "topic", n: str = "messages") -> DataFrame:
    """Messages to expect of the wanted topics, null if none."""
    return channels.where(F.col(topic).isin(topics)).agg(F.nullif(F.sum(n), F.lit(0)).alias("expected"))


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed import has left to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def skip_on_error(steps: DataFrame, episode: str, error: Column, mode: str) -> DataFrame:
    """Without the failed steps (``step``) or the episodes that have any (``episode``).

    ``all`` fails at run time on the first error.
    """
    failed = F.coalesce(error, F.lit(False))
    if mode == "step":
        return steps.where(~failed)
    if mode == "episode":
        return steps.join(steps.where(failed).select(episode).distinct(), episode, "left_anti")
    if mode == "all":
        return steps.where(F.when(failed, F.raise_error(F.lit("a step failed")).cast("boolean")).otherwise(F.lit(True)))
    raise ValueError(f"unknown mode {mode!r}")


def latest_version(rows: DataFrame, by: str, version: str) -> DataFrame:
    """The version that sorts last as text."""
    return rows.groupBy(by).agg(F.max(version).alias("version"))


def dataset_kind(names: list[str]) -> str | None:
    """Kind of a dataset by the marker files in its first two levels, most telling first."""
    base = [n.rsplit("/", 1)[-1].lower() for n in names]
    if any(n.endswith(".mcap") for n in base):
        return "mcap"
    if "dataset_info.json" in base and any(".tfrecord" in n for n in base):
        return "rlds"
    if any(n.lower().endswith("meta/info.json") for n in names):
        return "lerobot"
    if "dataset_info.json" in base or "features.json" in base:
        return "tfds"
    return None
