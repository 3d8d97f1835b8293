import json
import struct

import pytest

from kelpline.dataset import Dataset
from kelpline.functions import decoders
from kelpline.recorder import DATA_TYPES, Recorder
from kelpline.sources.cache import cached, spec_key

GOOD = {
    "JOINT_POSITIONS": 0.1, "JOINT_VELOCITIES": 0.1, "JOINT_TORQUES": 0.1, "JOINT_TARGET_POSITIONS": 0.2, "VISUAL_JOINT_POSITIONS": 0.3, "PARALLEL_GRIPPER_OPEN_AMOUNTS": 0.5, "PARALLEL_GRIPPER_TARGET_OPEN_AMOUNTS": 0.5,
    "POSES": [0.1, 0.2, 0.3, 0, 0, 0, 1], "END_EFFECTOR_POSES": [1, 2, 3, 0, 0, 0, 1], "CUSTOM_1D": [1, 2, 3], "LANGUAGE": "a statement", "RGB_IMAGES": b"\0" * 12, "DEPTH_IMAGES": b"\0" * 4, "POINT_CLOUDS": b"\0" * 6,
}


def test_every_type_round_trips(spark):
    assert set(GOOD) == set(DATA_TYPES)
    r = Recorder("robot")
    r.start_recording(0.0)
    for kind, value in GOOD.items():
        r.log(kind, "s", value, timestamp=1.0)
    r.stop_recording(2.0)
    got = {x["data_type"]: x for x in r.flushed(spark).collect()}
    for kind, value in GOOD.items():
        x = got[kind]
        kept = next(x[c] for c in ("v", "vec", "text", "blob") if x[c] is not None)
        assert kept == ([float(v) for v in value] if isinstance(value, list) else value)
    assert r.flushed(spark).count() == 0


@pytest.mark.parametrize(("kind", "value", "error"), [("JOINT_POSITIONS", 1, TypeError), ("PARALLEL_GRIPPER_OPEN_AMOUNTS", 1.2, ValueError), ("POSES", [1.0], ValueError), ("END_EFFECTOR_POSES", [0, 0, 0, 0, 0, 0, 2], ValueError), ("LANGUAGE", 5, TypeError), ("SMELL", 1.0, ValueError)])
def test_bad_values(kind, value, error):
    r = Recorder("robot")
    r.start_recording(0.0)
    with pytest.raises(error):
        r.log(kind, "s", value, dry_run=True)


def test_times_rise_within_a_recording():
    r = Recorder("robot")
    r.log_joint_position("j", 0.0, timestamp=9.0)  # nothing is recorded
    r.start_recording(0.0)
    r.log_joint_positions({"j": 0.1, "k": 0.2}, timestamp=1.0)
    with pytest.raises(ValueError):
        r.log_joint_position("j", 0.1, timestamp=1.0)
    r.cancel_recording()
    assert r.rows == [] and not r.is_recording()
    r.start_recording(0.0)
    r.log_joint_position("j", 0.1, timestamp=0.5)
    assert len(r.rows) == 1
    with pytest.raises(RuntimeError):
        r.start_recording()


def test_dataset(spark):
    rows = [(r, s, t * 100_000, float(t)) for r in (1, 2) for s in ("joint", "target") for t in range(10)]
    data = Dataset(spark.createDataFrame(rows, "recording_id long, sensor string, ts_us long, value double"))
    assert len(data) == 2 and len(data.merged(data)) == 2 and data.only("joint").sensors().count() == 1
    synced = data.synchronise(10.0, max_delay_us=0)
    assert synced.rows.count() == 40 and synced.statistics().where("sensor = 'joint'").first()["mean"] == 4.5
    w = {(x["sensor"], x["step"]): x["chunk"] for x in synced.windows(3, ["target"]).where("recording_id = 1").collect()}
    assert w["target", 4] == [4, 5, 6] and w["joint", 4] == [5, 6, 7] and w["joint", 8] == [9, 9, 9] and w["target", 8] == [8, 9, 9] and ("joint", 9) not in w
    assert synced.step(-1).count() == 4 and synced.wide(["joint", "target"]).count() == 20
    assert data.synchronise().rows.count() == 40
    with pytest.raises(ValueError):
        data.synchronise(-1.0)


def test_cache_is_keyed_by_its_specification(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert cached(spark, {"n": n}, lambda n=n: build(n), f"file://{tmp_path}").count() == n
    assert built == [3, 4] and spec_key({"a": 1, "b": 2}) == spec_key({"b": 2, "a": 1})


@pytest.mark.parametrize(("raw", "want"), [(b"\x83\x01\x20\x43abc", [1, -1, b"abc"]), (b"\xa1\x61a\xf5", {"a": True}), (b"\x9f\x01\xff", [1]), (b"\xfb\x3f\xf8\0\0\0\0\0\0", 1.5), (b"\xf9\x3e\x00", 1.5), (b"\x19\x03\xe8", 1000), (b"\x7f\x61a\x61b\xff", "ab"), (b"\xc1\x0a", 10)])
def test_cbor(raw, want):
    assert decoders.cbor(raw) == want


def test_robot_messages():
    text = "Header header\nfloat64[] x\nuint8 k\nstring s\nint32 A=5\n===\nMSG: std_msgs/Header\nuint32 seq\ntime stamp\n"
    packed = struct.pack("<Iii", 7, 1, 2) + struct.pack("<I2d", 2, 0.5, 1.5) + b"\x09" + struct.pack("<I", 2) + b"hi"
    want = {"header": {"seq": 7, "stamp": {"sec": 1, "nanosec": 2}}, "x": [0.5, 1.5], "k": 9, "s": "hi"}
    assert decoders.robot_message(packed, text, False) == want
    aligned = b"\0\1\0\0" + struct.pack("<Iii", 7, 1, 2) + struct.pack("<I2d", 2, 0.5, 1.5) + b"\x09\0\0\0" + struct.pack("<I", 3) + b"hi\0"
    assert decoders.robot_message(aligned, text, True) == want


def test_decode_falls_back_to_raw(spark):
    rows = [(bytearray(b'{"x": [1, 2]}'), "json", ""), (bytearray(b"hi"), "text", ""), (bytearray(b"\xff"), "text", ""), (bytearray(b"\0"), "odd", ""), (None, "json", "")]
    df = spark.createDataFrame(rows, "d binary, e string, t string").select(decoders.decode("d", "e", "t").alias("j"))
    assert [None if r["j"] is None else json.loads(r["j"]) for r in df.collect()] == [{"x": [1, 2]}, "hi", {"data": "/w=="}, {"data": "AA=="}, None]
