"""Validators of samples: a text where something is wrong, else null.

Spark orders NaN above every number; where NaN must pass a limit, it is said so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
DEPTH_LIMIT = 10.0  # metres
CLOUD_LIMIT = 307_200  # points


def joint_position(x: Column, low: Column, high: Column) -> Column:
    """Limits with a tolerance; null limits and NaN pass."""
    bad = ~F.isnan(x) & ((x < low - TOLERANCE) | (x > high + TOLERANCE))
    return F.when(bad, F.lit("position outside limits"))


def joint_magnitude(x: Column, limit: Column, what: str = "velocity") -> Column:
    """Size against a limit without tolerance; a null limit and NaN pass."""
    return F.when(~F.isnan(x) & (F.abs(x) > limit), F.lit(f"{what} over limit"))


def gripper(x: Column) -> Column:
    return F.when(F.isnan(x) | ~x.between(0.0, 1.0), F.lit("gripper outside 0 to 1"))


def unit_quaternion(pose: Column) -> Column:
    """[x, y, z, qx, qy, qz, qw] whose quaternion has length 1 to within 1e-4 (and 1e-5 relative)."""
    q = F.slice(pose, 4, 4)
    norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return F.when(F.size(pose) != 7, F.lit("pose needs 7 elements")).when(~(F.abs(norm - 1) <= 1e-4 + 1e-5), F.lit("quaternion not of unit length"))


def shape(channels: Column, height: Column, width: Column, n_bytes: Column) -> Column:
    """An image of three 8-bit channels that fills its shape."""
    return F.when(channels != 3, F.lit("3 channels needed")).when(height * width * channels != n_bytes, F.lit("bytes do not fill the shape"))


def depth(values: Column) -> Column:
    return F.when(F.exists(values, lambda d: ~F.isnan(d) & (d > DEPTH_LIMIT)), F.lit("depth over 10 m"))


def cloud(points: Column, colours: Column | None = None) -> Column:
    n = F.size(points)
    bad = F.when(n > CLOUD_LIMIT, F.lit("too many points")).when(F.exists(points, lambda p: F.size(p) != 3), F.lit("points need 3 coordinates"))
    return bad if colours is None else F.coalesce(bad, F.when(F.size(colours) != n, F.lit("as many colours as points needed")))


def language(text: Column) -> Column:
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit("empty text"))


def pose_length(values: Column, kind: str) -> Column:
    """Elements that a pose format needs."""
    need = {"matrix": 16, "position_quaternion": 7, "position_euler": 6, "position_axis_angle": 6, "position_matrix": 9}[kind]
    return F.when(F.size(values) != need, F.lit(f"{kind} needs {need} elements"))
