"""Poses as columns: [x, y, z, qx, qy, qz, qw], all in SQL arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _q(pose: Column) -> list[Column]:
    return [F.get(pose, i) for i in (3, 4, 5, 6)]


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two quaternions (x, y, z, w)."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def rotate(q: list[Column], v: list[Column]) -> list[Column]:
    """A vector turned by a unit quaternion: v + w t + q x t with t = 2 q x v."""
    x, y, z, w = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return [v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx]


def compose(current: Column, delta: Column) -> Column:
    """The pose reached from ``current`` by a relative ``delta`` in its frame."""
    q = _q(current)
    moved = rotate(q, [F.get(delta, i) for i in (0, 1, 2)])
    return F.array(*(F.get(current, i) + m for i, m in enumerate(moved)), *multiply(q, _q(delta)))


def from_euler(values: Column, degrees: bool = False) -> Column:
    """Position and roll, pitch, yaw (turned about x, then y, then z)."""
    angle = [F.get(values, i) for i in (3, 4, 5)]
    angle = [F.radians(a) if degrees else a for a in angle]
    (sr, cr), (sp, cp), (sy, cy) = [(F.sin(a / 2), F.cos(a / 2)) for a in angle]
    q = [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]
    return F.array(*(F.get(values, i) for i in range(3)), *q)


def from_axis_angle(values: Column) -> Column:
    """Position and a rotation vector whose length is the angle."""
    r = [F.get(values, i) for i in (3, 4, 5)]
    angle = F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])
    scale = F.when(angle > 1e-12, F.sin(angle / 2) / angle).otherwise(F.lit(0.5))
    return F.array(*(F.get(values, i) for i in range(3)), *(x * scale for x in r), F.cos(angle / 2))


def from_matrix(m: Column) -> Column:
    """A row-major 4 x 4 transform; the quaternion has w >= 0."""
    e = lambda i, j: F.get(m, 4 * i + j)
    half = lambda t: F.sqrt(F.greatest(t, F.lit(0.0))) / 2
    sign = lambda t: F.when(t < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    w = half(1 + e(0, 0) + e(1, 1) + e(2, 2))
    x, y, z = half(1 + e(0, 0) - e(1, 1) - e(2, 2)), half(1 - e(0, 0) + e(1, 1) - e(2, 2)), half(1 - e(0, 0) - e(1, 1) + e(2, 2))
    return F.array(e(0, 3), e(1, 3), e(2, 3), x * sign(e(2, 1) - e(1, 2)), y * sign(e(0, 2) - e(2, 0)), z * sign(e(1, 0) - e(0, 1)), w)


def forward(joints: Column, links: list[tuple[float, float]]) -> Column:
    """End pose (x, y, heading) of a planar chain: (length, offset angle) of each link."""
    x, y, heading = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k, (length, offset) in enumerate(links):
        heading = heading + F.get(joints, k) + offset
        x, y = x + length * F.cos(heading), y + length * F.sin(heading)
    return F.array(x, y, heading)
