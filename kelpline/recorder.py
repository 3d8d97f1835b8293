"""Recording of samples: validated when logged, written as long rows.

Meant for the few thousand samples a second that one process logs; a fleet
writes its own files and the operators read them all.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "recording_id string, robot_id string, instance int, data_type string, sensor string, ts_us long, frame_idx long, v double, vec array<double>, text string, blob binary"
#: The data types of samples.
SCALARS = ("JOINT_POSITIONS", "JOINT_VELOCITIES", "JOINT_TORQUES", "JOINT_TARGET_POSITIONS", "VISUAL_JOINT_POSITIONS")
GRIPPERS = ("PARALLEL_GRIPPER_OPEN_AMOUNTS", "PARALLEL_GRIPPER_TARGET_OPEN_AMOUNTS")
POSES, VECTORS, TEXTS = ("POSES", "END_EFFECTOR_POSES"), ("CUSTOM_1D",), ("LANGUAGE",)
IMAGES = ("RGB_IMAGES", "DEPTH_IMAGES", "POINT_CLOUDS")
DATA_TYPES = (*SCALARS, *GRIPPERS, *POSES, *VECTORS, *TEXTS, *IMAGES)


def checked(data_type: str, value) -> dict:
    """Columns of a value; TypeError or ValueError where its type does not allow it."""
    if data_type in SCALARS or data_type in GRIPPERS:
        if not isinstance(value, float):
            raise TypeError(f"{data_type} takes floats, not {type(value).__name__}")
        if data_type in GRIPPERS and not 0.0 <= value <= 1.0:
            raise ValueError("an open amount lies between 0 and 1")
        return {"v": value}
    if data_type in POSES:
        pose = [float(x) for x in value]
        if len(pose) != 7:
            raise ValueError("a pose has 7 elements")
        if data_type == "END_EFFECTOR_POSES" and not abs(math.hypot(*pose[3:]) - 1) <= 1e-4 + 1e-5:
            raise ValueError("the quaternion is not of unit length")
        return {"vec": pose}
    if data_type in VECTORS:
        return {"vec": [float(x) for x in value]}
    if data_type in TEXTS:
        if not isinstance(value, str):
            raise TypeError("language takes text")
        return {"text": value}
    if data_type in IMAGES:
        return {"blob": bytes(value)}
    raise ValueError(f"unknown data type {data_type!r}")


class Recorder:
    """Logs samples of one robot between `start_recording` and `stop_recording`."""

    def __init__(self, robot_id: str, instance: int = 0):
        self.robot_id, self.instance = robot_id, instance
        self.recording_id: str | None = None
        self.rows: list[tuple] = []
        self._last: dict[tuple[str, str], tuple[float, int]] = {}
        self.windows: dict[str, list[float | None]] = {}

    def is_recording(self) -> bool:
        return self.recording_id is not None

    def start_recording(self, timestamp: float | None = None) -> str:
        if self.is_recording():
            raise RuntimeError("a recording is running")
        self.recording_id = uuid.uuid4().hex
        self.windows[self.recording_id] = [time.time() if timestamp is None else timestamp, None]
        self._last.clear()
        return self.recording_id

    def stop_recording(self, timestamp: float | None = None) -> None:
        if not self.is_recording():
            raise RuntimeError("no recording is running")
        self.windows[self.recording_id][1] = time.time() if timestamp is None else timestamp
        self.recording_id = None

    def cancel_recording(self) -> None:
        """Ends the recording and drops what it took in."""
        self.rows = [r for r in self.rows if r[0] != self.recording_id]
        self.windows.pop(self.recording_id, None)
        self.recording_id = None

    def log(self, data_type: str, sensor: str, value, timestamp: float | None = None, dry_run: bool = False) -> None:
        """Checks a sample and, unless ``dry_run``, keeps it; times of a stream must rise."""
        columns = checked(data_type, value)
        ts = time.time() if timestamp is None else timestamp
        if dry_run or not self.is_recording():
            return
        last, n = self._last.get((data_type, sensor), (-math.inf, 0))
        if ts <= last:
            raise ValueError(f"{data_type}:{sensor} went back from {last} to {ts}")
        self._last[data_type, sensor] = (ts, n + 1)
        own = tuple(columns.get(c) for c in ("v", "vec", "text", "blob"))
        self.rows.append((self.recording_id, self.robot_id, self.instance, data_type, sensor, round(ts * 1e6), n, *own))

    def log_many(self, data_type: str, values: Mapping[str, object], timestamp: float | None = None, dry_run: bool = False) -> None:
        """One sample a sensor; all are checked before any is kept."""
        for value in values.values():
            checked(data_type, value)
        for sensor, value in values.items():
            self.log(data_type, sensor, value, timestamp, dry_run)

    def log_joint_positions(self, positions: Mapping[str, float], **options) -> None:
        self.log_many("JOINT_POSITIONS", positions, **options)

    def log_joint_velocities(self, velocities: Mapping[str, float], **options) -> None:
        self.log_many("JOINT_VELOCITIES", velocities, **options)

    def log_joint_torques(self, torques: Mapping[str, float], **options) -> None:
        self.log_many("JOINT_TORQUES", torques, **options)

    def log_joint_target_positions(self, targets: Mapping[str, float], **options) -> None:
        self.log_many("JOINT_TARGET_POSITIONS", targets, **options)

    def log_visual_joint_positions(self, positions: Mapping[str, float], **options) -> None:
        self.log_many("VISUAL_JOINT_POSITIONS", positions, **options)

    def log_parallel_gripper_open_amounts(self, amounts: Mapping[str, float], **options) -> None:
        self.log_many("PARALLEL_GRIPPER_OPEN_AMOUNTS", amounts, **options)

    def log_parallel_gripper_target_open_amounts(self, amounts: Mapping[str, float], **options) -> None:
        self.log_many("PARALLEL_GRIPPER_TARGET_OPEN_AMOUNTS", amounts, **options)

    def log_joint_position(self, name: str, position: float, **options) -> None:
        self.log("JOINT_POSITIONS", name, position, **options)

    def log_joint_velocity(self, name: str, velocity: float, **options) -> None:
        self.log("JOINT_VELOCITIES", name, velocity, **options)

    def log_joint_torque(self, name: str, torque: float, **options) -> None:
        self.log("JOINT_TORQUES", name, torque, **options)

    def log_joint_target_position(self, name: str, target: float, **options) -> None:
        self.log("JOINT_TARGET_POSITIONS", name, target, **options)

    def log_visual_joint_position(self, name: str, position: float, **options) -> None:
        self.log("VISUAL_JOINT_POSITIONS", name, position, **options)

    def log_parallel_gripper_open_amount(self, name: str, amount: float, **options) -> None:
        self.log("PARALLEL_GRIPPER_OPEN_AMOUNTS", name, amount, **options)

    def log_parallel_gripper_target_open_amount(self, name: str, amount: float, **options) -> None:
        self.log("PARALLEL_GRIPPER_TARGET_OPEN_AMOUNTS", name, amount, **options)

    def log_pose(self, name: str, pose: Sequence[float], **options) -> None:
        self.log("POSES", name, pose, **options)

    def log_end_effector_pose(self, name: str, pose: Sequence[float], **options) -> None:
        self.log("END_EFFECTOR_POSES", name, pose, **options)

    def log_custom_1d(self, name: str, values: Sequence[float], **options) -> None:
        self.log("CUSTOM_1D", name, values, **options)

    def log_language(self, name: str, text: str, **options) -> None:
        self.log("LANGUAGE", name, text, **options)

    def log_rgb(self, name: str, image: bytes, **options) -> None:
        self.log("RGB_IMAGES", name, image, **options)

    def log_depth(self, name: str, image: bytes, **options) -> None:
        self.log("DEPTH_IMAGES", name, image, **options)

    def log_point_cloud(self, name: str, points: bytes, **options) -> None:
        self.log("POINT_CLOUDS", name, points, **options)

    def flushed(self, spark: SparkSession) -> DataFrame:
        """What has been logged since the last flush, as samples."""
        rows, self.rows = self.rows, []
        return spark.createDataFrame(rows, SCHEMA)
