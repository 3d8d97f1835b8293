"""Scalar functions: depth codec, sizes, names, hashes, labels, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH_MAX, LEVELS = 10.0, (1 << 24) - 1
UNITS = {"b": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4}


def depth_to_level(metres: Column) -> Column:
    """24-bit level of a depth, clipped to 0 to 10 m (NaN: 0)."""
    d = F.when(F.isnan(metres), F.lit(0.0)).otherwise(F.least(F.greatest(metres, F.lit(0.0)), F.lit(DEPTH_MAX)))
    return F.floor(d / DEPTH_MAX * LEVELS).cast("long")


def level_to_rgb(level: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(level, 16), F.shiftright(level, 8).bitwiseAND(255), level.bitwiseAND(255)


def rgb_to_depth(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) / F.lit(LEVELS) * DEPTH_MAX


def clip_depth(metres: Column) -> Column:
    """NaN and minus infinity to 0, plus infinity to 10 m, the rest clipped; in single precision."""
    return F.when(F.isnan(metres), F.lit(0.0)).otherwise(F.least(F.greatest(metres, F.lit(0.0)), F.lit(DEPTH_MAX))).cast("float")


def size_in_bytes(text: Column) -> Column:
    """Bytes of ``10gb``, ``1.5 MB``, ``512``: powers of 1024; null for anything else or 0."""
    clean = F.lower(F.trim(text))
    number, unit = (F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?b)?$", k) for k in (1, 2))
    power = F.lit(0)
    for name, p in UNITS.items():
        power = F.when(unit == name, F.lit(p)).otherwise(power)
    value = F.floor(F.when(number != "", number.cast("double")) * F.pow(F.lit(1024.0), power)).cast("long")
    return F.when(value > 0, value)


def next_free_name(taken: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """The wanted name, else the name with the smallest free number from 1.

    Each used number of a name is one row; the first gap is the first number
    above its own rank.
    """
    base, number = F.regexp_extract(name, r"^(.*?)_([1-9][0-9]*)$", 1), F.regexp_extract(name, r"^(.*?)_([1-9][0-9]*)$", 2)
    used = taken.select(base.alias("base"), F.when(number != "", number).cast("long").alias("n")).where("n is not null").distinct()
    runs = used.groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("ns").cast("long") + 1), F.col("ns")))
    free = runs.select("base", gap.alias("gap"))
    plain = taken.select(F.col(name).alias("same")).distinct()
    met = wanted.join(plain, F.col(name) == F.col("same"), "left").join(free, F.col(name) == F.col("base"), "left")
    return met.select(name, F.when(F.col("same").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("_"), F.coalesce("gap", F.lit(1)).cast("string"))).alias("free_name"))


def spec_hash(*columns: str, length: int = 16) -> Column:
    """The first digits of the SHA-256 of a row as compact JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, length)


def label_type(label: Column) -> Column:
    """Before the first colon."""
    return F.substring_index(label, ":", 1)


def label_name(label: Column) -> Column:
    """After the first colon (the whole label if it has none)."""
    return F.regexp_replace(label, "^[^:]*:", "")


def is_uuid(text: Column) -> Column:
    return text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def transformed(x: Column, degrees: bool = False, millimetres: bool = False, inverted: bool = False, offset: float = 0.0) -> Column:
    """Units first, then the sign, the offset last."""
    x = F.radians(x) if degrees else x
    x = x / 1000 if millimetres else x
    x = -x if inverted else x
    return x + offset if offset else x


def normalised_gripper(x: Column, low: float, high: float, inverted: bool = False) -> Column:
    y = (x - low) / (high - low)
    return 1 - y if inverted else y


def publish_offset_ms(frame_ns: Column, first_ns: Column) -> Column:
    """Whole milliseconds since the first frame, never under 0."""
    return F.greatest(F.lit(0), F.floor((frame_ns - first_ns) / 1_000_000)).cast("long")


def data_uri(payload: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(payload))


def from_data_uri(text: Column) -> Column:
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*,", ""))
