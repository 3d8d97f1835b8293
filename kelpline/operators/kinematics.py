"""Forward and inverse kinematics of serial chains.

Inverse kinematics is truly sequential: a step's solution seeds the next one
and every episode starts anew, so an episode is solved in one task. Episodes
are spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STEP, TOLERANCE, MOST = 0.5, 1e-6, 1000


def rotation(axis: np.ndarray, angle: float) -> np.ndarray:
    """Turn about a unit axis."""
    x, y, z = axis
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


@dataclass(frozen=True)
class Joint:
    """A joint's kind, axis and place in its parent's frame, and its limits (null: none)."""

    name: str
    parent: str
    child: str
    kind: str = "revolute"
    axis: tuple[float, float, float] = (0.0, 0.0, 1.0)
    place: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low: float | None = None
    high: float | None = None


def chain_to(joints: list[Joint], tip: str, base: str | None = None) -> list[Joint]:
    """The joints from ``base`` (or the root) to the link ``tip``, by walking up the parents."""
    above = {j.child: j for j in joints}
    found: list[Joint] = []
    link = tip
    while link != base and link in above:
        found.append(above[link])
        link = above[link].parent
        if len(found) > len(joints):
            raise ValueError("the links form a loop")
    if base is not None and link != base:
        raise ValueError(f"{tip!r} does not hang on {base!r}")
    return found[::-1]


def forward(chain: list[Joint], q: dict[str, float]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, Joint]]]:
    """The tip's 4 x 4 pose, and each moving joint's axis and place in the base's frame."""
    pose, frames = np.eye(4), []
    for j in chain:
        pose = pose.copy()
        pose[:3, 3] += pose[:3, :3] @ np.array(j.place)
        if j.kind == "fixed":
            continue
        axis = np.array(j.axis) / np.linalg.norm(j.axis)
        frames.append((pose[:3, :3] @ axis, pose[:3, 3].copy(), j))
        if j.kind == "prismatic":
            pose[:3, 3] += pose[:3, :3] @ axis * q[j.name]
        else:
            pose[:3, :3] = pose[:3, :3] @ rotation(axis, q[j.name])
    return pose, frames


def matrix(pose) -> np.ndarray:
    """4 x 4 matrix of [x, y, z, qx, qy, qz, qw]."""
    x, y, z, w = np.asarray(pose[3:], dtype=float) / np.linalg.norm(pose[3:])
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = pose[:3]
    return out


def _turn(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation matrix."""
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    s, c = np.linalg.norm(v), (np.trace(r) - 1) / 2
    if s < 1e-9:
        if c > 0:
            return v
        axis = np.sqrt(np.maximum((np.diag(r) + 1) / 2, 0))
        return np.pi * axis / np.linalg.norm(axis)
    return v / s * np.arctan2(s, c)


def inverse(chain: list[Joint], target: np.ndarray, start: dict[str, float], tolerance: float = TOLERANCE, most: int = MOST, damping: float = 1e-6) -> dict[str, float]:
    """Joint values that reach ``target``, from ``start``, by damped least squares; ArithmeticError if none."""
    q = {j.name: float(start.get(j.name, 0.0)) for j in chain if j.kind != "fixed"}
    for _ in range(most):
        pose, frames = forward(chain, q)
        error = np.concatenate([target[:3, 3] - pose[:3, 3], _turn(target[:3, :3] @ pose[:3, :3].T)])
        if np.linalg.norm(error) < tolerance:
            return q
        columns = [np.concatenate([a, np.zeros(3)]) if j.kind == "prismatic" else np.concatenate([np.cross(a, pose[:3, 3] - p), a]) for a, p, j in frames]
        jac = np.array(columns).T
        move = jac.T @ np.linalg.solve(jac @ jac.T + damping * np.eye(6), error)
        for (_, _, j), d in zip(frames, STEP * move, strict=True):
            q[j.name] += d
            if j.low is not None or j.high is not None:
                q[j.name] = float(np.clip(q[j.name], -np.inf if j.low is None else j.low, np.inf if j.high is None else j.high))
    raise ArithmeticError("the pose was not reached")


def solved(poses: DataFrame, chain: list[Joint], episode: str, order: str, pose: str = "pose", start: dict[str, float] | None = None) -> DataFrame:
    """(episode, order, joints) of target poses, each step seeded by the one before."""
    kinds = dict(poses.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, q, out = pdf.sort_values(order, kind="stable"), dict(start or {}), []
        for p in pdf[pose]:
            q = inverse(chain, matrix(p), q)
            out.append(dict(q))
        return pd.DataFrame({episode: pdf[episode], order: pdf[order], "joints": out})

    return poses.select(episode, order, pose).groupBy(episode).applyInPandas(run, f"{episode} {kinds[episode]}, {order} {kinds[order]}, joints map<string,double>")


def reached(joints: DataFrame, chain: list[Joint], keys: list[str], values: str = "joints") -> DataFrame:
    """The tip's position and row-major rotation for maps of joint values."""
    kinds = dict(joints.dtypes)

    def run(batches):
        for pdf in batches:
            poses = [forward(chain, dict(q))[0] for q in pdf[values]]
            yield pdf[keys].assign(position=[p[:3, 3].tolist() for p in poses], rotation=[p[:3, :3].ravel().tolist() for p in poses])

    return joints.select(*keys, values).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", position array<double>, rotation array<double>")
