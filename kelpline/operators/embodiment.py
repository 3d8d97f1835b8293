"""Layouts of sensors: slots, projections, masks, and sets of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.operators.stats import field


def project_strict(rows: DataFrame, layout: DataFrame, by: list[str], sensor: str = "sensor") -> DataFrame:
    """Rows of the layout's sensors, with their slots; fails at run time if a group lacks one.

    Sensors outside the layout are dropped.
    """
    wanted = layout.agg(F.count(F.lit(1)).alias("wanted"))
    met = rows.join(F.broadcast(layout), sensor)
    counted = met.withColumn("seen", F.size(F.collect_set(sensor).over(Window.partitionBy(*by)))).join(F.broadcast(wanted))
    slot = F.when(F.col("seen") == F.col("wanted"), F.col("slot")).otherwise(F.raise_error(F.lit("a requested sensor is missing")).cast("int"))
    return counted.withColumn("slot", slot).drop("seen", "wanted")


def missing_sensors(rows: DataFrame, layout: DataFrame, by: str, sensor: str = "sensor") -> DataFrame:
    """(group, sensor) of what the strict projection would fail on."""
    wanted = rows.select(by).distinct().join(F.broadcast(layout.select(sensor)))
    return wanted.join(rows.select(by, sensor).distinct(), [by, sensor], "left_anti")


def project_lenient(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    return rows.join(wanted.select(column), column, "left_semi")


def slot_ordered(rows: DataFrame, by: list[str], slot: str, value: str, name: str) -> DataFrame:
    """One array a group, its values in the order of slots."""
    own = F.array_sort(F.collect_list(F.struct(slot, value)))
    return rows.groupBy(*by).agg(F.transform(own, lambda s: s[value]).alias(name))


def slot_width(layout: DataFrame, by: list[str], slot: str = "slot") -> DataFrame:
    """Width that holds the largest slot of any robot, at least 1."""
    return layout.groupBy(*by).agg((F.greatest(F.max(slot), F.lit(0)) + 1).alias("width"))


def names_per_slot(layout: DataFrame, by: list[str], name: str) -> DataFrame:
    return layout.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(name)), " / ").alias("names"))


def masked(rows: DataFrame, width: int, by: list[str], slot: str = "slot", value: str = "value") -> DataFrame:
    """values and mask of ``width`` slots a group: absent slots are 0 with mask 0.

    Slots outside the width are an error at run time.
    """
    at = F.when(F.col(slot).between(0, width - 1), F.col(slot)).otherwise(F.raise_error(F.lit("more slots than the layout has")).cast("int"))
    present = F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col(value).alias("v"))))
    slots = F.sequence(F.lit(0), F.lit(width - 1))
    found = rows.groupBy(*by).agg(present.alias("present"))
    return found.select(
        *by, F.transform(slots, lambda k: F.coalesce(F.try_element_at("present", k), F.lit(0.0))).alias("values"),
        F.transform(slots, lambda k: F.when(F.map_contains_key("present", k), 1.0).otherwise(0.0)).alias("mask"),
    )


def collated(rows: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row a batch with each column as an array in the order of its samples."""
    own = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("s"))
    return own.select(batch, F.size("s").alias("batch_size"), *(F.transform("s", field(c)).alias(c) for c in columns))


def ordered_union(*names: Column) -> Column:
    """Distinct names, in the order in which they first occur."""
    return F.array_distinct(F.concat(*names))


def intersection_or_union(inputs: Column, outputs: Column) -> Column:
    """Sorted names in both, or, if there are none, in either."""
    both = F.array_intersect(inputs, outputs)
    return F.array_sort(F.when(F.size(both) > 0, both).otherwise(F.array_union(inputs, outputs)))


def lacking(rows: DataFrame, by: str, column: str, required: list[str]) -> DataFrame:
    """Groups that lack required names, with the sorted names that they lack."""
    seen = rows.where(F.col(column).isin(required)).groupBy(by).agg(F.collect_set(column).alias("seen"))
    every = rows.select(by).distinct().join(seen, by, "left")
    missing = F.array_except(F.array(*map(F.lit, sorted(required))), F.coalesce("seen", F.array().cast("array<string>")))
    return every.select(by, missing.alias("missing")).where(F.size("missing") > 0)


def groups_by_lack(rows: DataFrame, by: str, column: str, required: list[str]) -> DataFrame:
    """Each missing name with the sorted groups that lack it."""
    lack = lacking(rows, by, column, required).select(by, F.explode("missing").alias("missing"))
    return lack.groupBy("missing").agg(F.array_sort(F.collect_list(by)).alias("groups"))


def relative_to_same_step(targets: DataFrame, positions: DataFrame, on: list[str]) -> DataFrame:
    """Absolute targets: each delta plus the joint's position at the same step; none is an error."""
    met = targets.join(positions, on, "left")
    now = F.when(F.col("position").isNotNull(), F.col("position")).otherwise(F.raise_error(F.lit("no current position")).cast("double"))
    return met.withColumn("target", F.col("delta") + now)


def fully_connected(streams: DataFrame, peers: DataFrame, by: str, node: str) -> DataFrame:
    """Whether every stream of a robot has a connected peer."""
    met = streams.join(peers.where("connected").select(node).distinct().withColumn("up", F.lit(True)), node, "left")
    return met.groupBy(by).agg(F.bool_and(F.coalesce("up", F.lit(False))).alias("all_connected"))


def resolve_names(wanted: DataFrame, private: DataFrame, shared: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """Ids of names, private before shared, the first match of each."""
    both = private.select(name, key, F.lit(0).alias("rank")).unionByName(shared.select(name, key, F.lit(1).alias("rank")))
    best = both.groupBy(name).agg(F.min(F.struct("rank", key)).getField(key).alias(key))
    return wanted.join(best, name, "left")


def with_limits(samples: DataFrame, limits: DataFrame, joint: str = "joint") -> DataFrame:
    """Attaches a joint's limits; a joint that the table doesn't have is an error at run time.

    Limits themselves may be null. The table is a robot's description.
    """
    met = samples.join(F.broadcast(limits.withColumn("known", F.lit(True))), joint, "left")
    unknown = F.raise_error(F.concat(F.lit("no such joint: "), F.col(joint))).cast("boolean")
    return met.where(F.when(F.col("known").isNull(), unknown).otherwise(F.lit(True))).drop("known")
