"""Routing of samples into recordings by their windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def route(data: DataFrame, windows: DataFrame, source: str = "source", slot_us: int | None = None) -> DataFrame:
    """Adds the window (window_id or null) of each row of ``data`` (row_id, ts).

    A window holds [start, stop); a null stop is open. Closed windows come
    before open ones, the newest first. The join is on the source, so it is a
    hash or sort-merge join with a filter. With ``slot_us``, it is also on
    slots of time, so that sources with many windows don't meet all their rows
    with all of them; open windows then reach to the last sample of their source.
    """
    if slot_us:
        last = data.groupBy(source).agg(F.max("ts").alias("last_ts"))
        slots = F.sequence(F.floor(F.col("start") / slot_us), F.floor(F.coalesce(F.col("stop") - 1, F.greatest("last_ts", "start")) / slot_us))
        w = windows.join(last, source).where(F.coalesce(F.col("stop"), F.col("last_ts") + 1) > F.col("start")).withColumn("slot", F.explode(slots)).drop("last_ts")
        d, on = data.withColumn("slot", F.floor(F.col("ts") / slot_us)), [source, "slot"]
    else:
        d, w, on = data, windows, [source]
    met = d.join(w, on).where((F.col("ts") >= F.col("start")) & (F.col("stop").isNull() | (F.col("ts") < F.col("stop"))))
    rank = F.struct(F.col("stop").isNotNull(), F.col("start"), F.col("window_id"))
    best = met.groupBy("row_id").agg(F.max_by("window_id", rank).alias("window_id"))
    return data.join(best, "row_id", "left")


def orphans(data: DataFrame, windows: DataFrame, source: str = "source") -> DataFrame:
    """Rows outside every window."""
    inside = (F.col("d.ts") >= F.col("w.start")) & (F.col("w.stop").isNull() | (F.col("d.ts") < F.col("w.stop")))
    return data.alias("d").join(windows.alias("w"), (F.col(f"d.{source}") == F.col(f"w.{source}")) & inside, "left_anti")


def closed_by_next(windows: DataFrame, source: str = "source") -> DataFrame:
    """A window without a stop ends where the next one of its source starts."""
    following = F.lead("start").over(Window.partitionBy(source).orderBy("start", "window_id"))
    return windows.withColumn("stop", F.coalesce("stop", following))


def straddle_cut(frames: DataFrame, chunk: str, order: str, offset_us: str, bound: str) -> DataFrame:
    """The frames of each chunk before its bound: the first one at or past it ends the chunk."""
    line = Window.partitionBy(chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.bool_or(F.coalesce(F.col(offset_us) >= F.col(bound), F.lit(False))).over(line)
    return frames.withColumn("passed", passed).where(~F.col("passed")).drop("passed")


def expired(windows: DataFrame, most_us: int) -> DataFrame:
    """Windows cut off at a greatest length."""
    longest = F.col("start") + most_us
    return windows.withColumn("stop", F.least(F.coalesce("stop", longest), longest))


def idle_closed(data: DataFrame, source: str, gap_us: int) -> DataFrame:
    """Windows that silence closes: a gap of more than ``gap_us`` starts the next one."""
    line = Window.partitionBy(source).orderBy("ts", "row_id")
    starts = F.coalesce((F.col("ts") - F.lag("ts").over(line) > gap_us).cast("long"), F.lit(1))
    marked = data.withColumn("is_start", starts).withColumn("nth", F.sum("is_start").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(source, "nth").agg(F.min("ts").alias("start"), (F.max("ts") + gap_us).alias("stop"), F.count(F.lit(1)).alias("rows"))


def cancelled(data: DataFrame, cancels: DataFrame, source: str = "source") -> DataFrame:
    """Drops what a source published before its cancellation."""
    last = cancels.groupBy(source).agg(F.max("ts").alias("cancel_ts"))
    return data.join(last, source, "left").where(F.col("cancel_ts").isNull() | (F.col("ts") > F.col("cancel_ts"))).drop("cancel_ts")


def admitted(frames: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Frames while the running sum of sizes stays within a budget."""
    line = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("used", F.sum(size).over(line)).where(F.col("used") <= budget)


def flushed(windows: DataFrame, producers: DataFrame, flushes: DataFrame) -> DataFrame:
    """Windows all of whose producers have reported a flush: (window_id, producer) tables."""
    owed = producers.join(flushes.select("window_id", "producer").distinct().withColumn("done", F.lit(True)), ["window_id", "producer"], "left")
    ready = owed.groupBy("window_id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("ready"))
    return windows.join(ready, "window_id", "left").where(F.coalesce("ready", F.lit(True))).drop("ready")
