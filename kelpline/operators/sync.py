"""Synchronisation of independently clocked streams onto a common clock.

Samples are long rows (recording_id, sensor, ts_us, value). A grid gives each
recording its steps; every (step, sensor) gets the sample that is current
there. Streams are cut into time buckets, so a recording of any length is
spread over many tasks; what a bucket inherits from earlier ones is carried in
as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STREAM = ("recording_id", "sensor")
HOUR = 3_600_000_000
#: Width of a time bucket.
BUCKET_US = 24 * HOUR
#: Steps of a sample that are exploded at once.
STEPS = 4096


def bounds(samples: DataFrame, trim: bool = False) -> DataFrame:
    """recording_id, start_us, end_us of the common clock.

    ``trim``: from the last stream's first sample to the first stream's last;
    otherwise from the first sample to the last.
    """
    streams = samples.groupBy(*STREAM).agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    start, end = (F.max("first"), F.min("last")) if trim else (F.min("first"), F.max("last"))
    return streams.groupBy("recording_id").agg(start.alias("start_us"), end.alias("end_us"))


def periodic_grid(clock: DataFrame, period_us: int) -> DataFrame:
    """recording_id, step, grid_us: every period from start to end."""
    if period_us <= 0:
        raise ValueError("the period must be positive")
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("end_us") - F.col("start_us")) / period_us).cast("long"))
    rows = clock.where("start_us <= end_us").select("recording_id", "start_us", F.explode(steps).alias("step"))
    return rows.select("recording_id", "step", (F.col("start_us") + F.col("step") * period_us).alias("grid_us"))


def aperiodic_grid(samples: DataFrame) -> DataFrame:
    """recording_id, step, grid_us: every distinct time of any stream."""
    times = samples.select("recording_id", F.col("ts_us").alias("grid_us")).distinct()
    step = F.row_number().over(Window.partitionBy("recording_id").orderBy("grid_us")) - 1
    return times.select("recording_id", step.cast("long").alias("step"), "grid_us")


def for_each_sensor(grid: DataFrame, samples: DataFrame) -> DataFrame:
    """A row of the grid for every sensor of its recording."""
    return grid.join(samples.select(*STREAM).distinct(), "recording_id")


def asof(samples: DataFrame, grid: DataFrame, direction: str = "backward", bucket_us: int = BUCKET_US) -> DataFrame:
    """Adds src_us and value of the current sample to (recording_id, sensor, step, grid_us).

    ``backward``: the latest sample at or before the grid's time. ``nearest``:
    the closer of that and the first one after; the earlier on ties. Of samples
    at the same instant the one with the greatest value counts; a null value is
    carried as a value. Both are null where there is no sample.
    """
    if direction not in ("backward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    bucket = lambda c: F.floor(F.col(c) / bucket_us).alias("bucket")
    own = F.struct("ts_us", "value")
    s = samples.select(*STREAM, bucket("ts_us"), F.col("ts_us").alias("at"), F.lit(0).alias("kind"), own.alias("s"), F.lit(None).cast("long").alias("step"))
    g = grid.select(*STREAM, bucket("grid_us"), F.col("grid_us").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(s.schema["s"].dataType).alias("s"), "step")
    ends = s.groupBy(*STREAM, "bucket").agg(F.max("s").alias("last"), F.min(F.struct("at", F.struct("s.ts_us", "s.value").alias("s"))).getField("s").alias("first"))
    buckets = ends.join(g.select(*STREAM, "bucket").distinct(), [*STREAM, "bucket"], "full")
    line = Window.partitionBy(*STREAM).orderBy("bucket")
    before = F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    carried = buckets.select(*STREAM, "bucket", before.alias("before"), after.alias("after"))
    both = s.unionByName(g)
    inside = Window.partitionBy(*STREAM, "bucket").orderBy("at", "kind", "s")
    back = F.last("s", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("back")
    ahead = F.first("s", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("ahead")
    columns = [back, ahead] if direction == "nearest" else [back]
    met = both.select("*", *columns).where("kind = 1").join(carried, [*STREAM, "bucket"])
    b = F.coalesce("back", "before")
    if direction == "backward":
        picked = b
    else:
        a = F.coalesce("ahead", "after")
        closer = (a["ts_us"] - F.col("at") < F.col("at") - b["ts_us"]) | b.isNull()
        picked = F.when(a.isNotNull() & closer, a).otherwise(b)
    met = met.withColumn("p", picked)
    return met.select(*STREAM, "step", F.col("at").alias("grid_us"), F.col("p.ts_us").alias("src_us"), F.col("p.value").alias("value"))


def periodic(samples: DataFrame, clock: DataFrame, period_us: int, direction: str = "backward", bucket_us: int = BUCKET_US) -> DataFrame:
    """What ``asof`` gives for every step and sensor of a periodic clock, without rows for steps before the end.

    A sample serves the steps up to the next one of its stream, so the samples
    alone are dealt out and sorted, and each is then repeated in place. A row
    is exploded by blocks of steps, so that no array grows with a silence.
    """
    if direction not in ("backward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    if period_us <= 0:
        raise ValueError("the period must be positive")
    s = samples.where("recording_id is not null and sensor is not null").select(*STREAM, F.floor(F.col("ts_us") / bucket_us).alias("bucket"), F.struct("ts_us", "value").alias("s"))
    timed = s.where("bucket is not null")
    of = clock.where("start_us <= end_us").select("recording_id", "start_us", "end_us")
    ends = timed.groupBy(*STREAM, "bucket").agg(F.min("s").alias("first"))
    after = F.lead("first").over(Window.partitionBy(*STREAM).orderBy("bucket")).alias("after")
    carried = ends.join(of, "recording_id").select(*STREAM, "bucket", "start_us", "end_us", after)
    # of samples at one instant all but the last, the greatest, serve no step
    following = F.lead("s").over(Window.partitionBy(*STREAM, "bucket").orderBy("s")).alias("following")
    own = timed.select("*", following).join(carried, [*STREAM, "bucket"]).select(*STREAM, "start_us", "end_us", F.col("s").alias("back"), F.coalesce("following", "after").alias("ahead"))
    # steps before a stream's first sample; of a stream without a time, all
    leading = s.groupBy(*STREAM).agg(F.min(F.when(F.col("bucket").isNotNull(), F.col("s"))).alias("ahead")).join(of, "recording_id")
    leading = leading.select(*STREAM, "start_us", "end_us", F.lit(None).cast(s.schema["s"].dataType).alias("back"), "ahead")
    from_step = lambda c: F.ceil((F.col(c)["ts_us"] - F.col("start_us")) / period_us)
    low = F.greatest(F.coalesce(from_step("back"), F.lit(0)), F.lit(0)).cast("long")
    final = F.floor((F.col("end_us") - F.col("start_us")) / period_us)
    high = F.least(F.coalesce(from_step("ahead") - 1, final), final).cast("long")
    rows = own.unionByName(leading).select("*", low.alias("low"), high.alias("high")).where("low <= high")
    rows = rows.withColumn("block", F.explode(F.sequence("low", "high", F.lit(STEPS))))
    rows = rows.withColumn("step", F.explode(F.sequence("block", F.least(F.col("block") + (STEPS - 1), F.col("high")))))
    rows = rows.withColumn("grid_us", F.col("start_us") + F.col("step") * period_us)
    picked = F.col("back")
    if direction == "nearest":
        closer = (F.col("ahead.ts_us") - F.col("grid_us") < F.col("grid_us") - F.col("back.ts_us")) | F.col("back").isNull()
        picked = F.when(F.col("ahead").isNotNull() & closer, F.col("ahead")).otherwise(F.col("back"))
    return rows.select(*STREAM, "step", "grid_us", picked["ts_us"].alias("src_us"), picked["value"].alias("value"))


def wide(synced: DataFrame, sensors: list[str]) -> DataFrame:
    """A row a step with a column a sensor; steps of other sensors too, in one shuffle of the rows."""
    columns = [F.max(F.when(F.col("sensor") == x, F.col("value"))).alias(x) for x in sensors]
    return synced.groupBy("recording_id", "step", "grid_us").agg(*columns)


def within_delay(synced: DataFrame, max_delay_us: int) -> DataFrame:
    """Nulls what is further from its step than ``max_delay_us``."""
    ok = F.abs(F.col("grid_us") - F.col("src_us")) <= max_delay_us
    return synced.withColumn("value", F.when(ok, F.col("value"))).withColumn("src_us", F.when(ok, F.col("src_us")))


def without_duplicates(synced: DataFrame) -> DataFrame:
    """Keeps a sample at the first step that it serves only."""
    kept = [c for c in synced.columns if c not in (*STREAM, "src_us", "step")]
    # sums up before rows are dealt out: the steps of a sample stand together
    first = synced.where("src_us is not null").groupBy(*STREAM, "src_us").agg(F.min("step").alias("step"), *(F.min_by(c, "step").alias(c) for c in kept))
    return first.select(*synced.columns)


def failures(synced: DataFrame, max_delay_us: int, allow_duplicates: bool) -> DataFrame:
    """recording_id and failure: what would fail the synchronisation, or null.

    The delay is checked before the density.
    """
    late = F.coalesce(F.abs(F.col("grid_us") - F.col("src_us")) > max_delay_us, F.lit(True))
    uses = synced.groupBy(*STREAM, "src_us").agg(F.max(late).alias("late"), F.count(F.lit(1)).alias("uses"))
    per = uses.groupBy("recording_id").agg(F.max("late").alias("late"), F.max(F.col("uses") > 1).alias("repeated"))
    sparse = F.col("repeated") & F.lit(not allow_duplicates)
    return per.select("recording_id", F.when(F.col("late"), "within max delta").when(sparse, "too sparse").alias("failure"))


def moved_from_start(samples: DataFrame, threshold: float) -> DataFrame:
    """Drops a recording's leading samples while every sensor stays near its first value.

    A recording starts at the first time at which some sensor differs from its
    first value by more than ``threshold``; one that never moves loses all.
    """
    first = samples.groupBy(*STREAM).agg(F.min(F.struct("ts_us", "value")).getField("value").alias("v0"))
    moved = samples.join(first, list(STREAM)).where(F.abs(F.col("value") - F.col("v0")) > threshold)
    since = moved.groupBy("recording_id").agg(F.min("ts_us").alias("since"))
    return samples.join(since, "recording_id").where("ts_us >= since").drop("since")


def synchronise(
    samples: DataFrame,
    period_us: int | None,
    sensors: list[str] | None = None,
    max_delay_us: int | None = None,
    allow_duplicates: bool = True,
    trim_start_end: bool = True,
    no_movement_threshold: float | None = None,
    direction: str = "backward",
) -> DataFrame:
    """Synchronised rows; fails at run time where a recording can't be synchronised.

    ``period_us`` None: aperiodic, a step for every time of a selected stream.
    """
    if sensors is not None:
        known = F.collect_set("sensor")
        missing = samples.agg(F.array_except(F.array(*map(F.lit, sensors)), known).alias("m")).first()["m"]
        if missing:
            raise ValueError(f"No sensors found for data type: {', '.join(sorted(missing))}")
        samples = samples.where(F.col("sensor").isin(sensors))
    if no_movement_threshold is not None:
        samples = moved_from_start(samples, no_movement_threshold)
    clock = bounds(samples, trim_start_end)
    if period_us:
        out = periodic(samples, clock, period_us, direction)
    else:
        grid = aperiodic_grid(samples)
        if trim_start_end:
            grid = grid.join(clock, "recording_id").where("grid_us between start_us and end_us").drop("start_us", "end_us")
        out = asof(samples, for_each_sensor(grid, samples), direction)
    checks: list[tuple[Column, str]] = []
    if max_delay_us is not None:
        checks.append((F.abs(F.col("grid_us") - F.col("src_us")) > max_delay_us, "not within max delta"))
    if not allow_duplicates:
        out = out.withColumn("uses", F.count(F.lit(1)).over(Window.partitionBy(*STREAM, "src_us")))
        checks.append(((F.col("uses") > 1) & F.col("src_us").isNotNull(), "streams too sparse for this frequency"))
    src = F.col("src_us")
    for failed, message in reversed(checks):
        src = F.when(failed, F.raise_error(F.concat(F.lit(f"recording {message}: "), F.col("recording_id").cast("string"))).cast("long")).otherwise(src)
    return out.withColumn("src_us", src).drop("uses")
