import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from kelpline.sources import mcap, tfrecord, traces
from kelpline.streaming import router, tables


def record(opcode, body):
    return struct.pack("<BQ", opcode, len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def log(compression=""):
    schema = record(mcap.SCHEMA, struct.pack("<H", 1) + text("Joint") + text("json") + struct.pack("<I", 0))
    channels = b"".join(record(mcap.CHANNEL, struct.pack("<HH", k, 1) + text(t) + text("json") + struct.pack("<I", 0)) for k, t in ((1, "/a"), (2, "/b")))
    msgs = b"".join(record(mcap.MESSAGE, struct.pack("<HIQQ", c, k, 100 - k, 7) + b'{"x":%d}' % k) for k, c in enumerate([1, 2, 1]))
    inner = schema + channels + msgs
    held = inner
    if compression == "zstd":
        import zstandard

        held = zstandard.ZstdCompressor().compress(inner)
    chunk = record(mcap.CHUNK, struct.pack("<QQQI", 0, 100, len(inner), zlib.crc32(inner)) + text(compression) + struct.pack("<Q", len(held)) + held)
    return mcap.MAGIC + record(1, text("") + text("test")) + chunk + record(2, bytes(20)) + mcap.MAGIC


@pytest.mark.parametrize("compression", ["", "zstd"])
def test_mcap(spark, tmp_path, compression):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.mcap").write_bytes(log(compression))
    (tmp_path / "other.bin").write_bytes(b"no")
    df = mcap.read_mcap(spark, f"file://{tmp_path}")
    assert [(r["topic"], r["log_ns"], r["data"]) for r in df.orderBy("log_ns").collect()] == [("/a", 98, b'{"x":2}'), ("/b", 99, b'{"x":1}'), ("/a", 100, b'{"x":0}')]
    assert mcap.read_mcap(spark, f"file://{tmp_path}/sub/x.mcap", ["/b"]).count() == 1
    with pytest.raises(ValueError):
        list(mcap.messages(b"not a log"))


def test_tfrecord(spark, tmp_path):
    def field(n, body):
        return bytes([n << 3 | 2, len(body)]) + body

    def feature(name, kind, payload):
        return field(1, field(1, name) + field(2, field(kind, payload)))

    example = field(1, feature(b"t", 1, field(1, b"hi")) + feature(b"f", 2, field(1, struct.pack("<2f", 1.5, -2.0))) + feature(b"i", 3, field(1, bytes([5, 0x96, 0x01]))))
    framed = struct.pack("<Q", len(example))
    framed += struct.pack("<I", tfrecord.masked(framed)) + example + struct.pack("<I", tfrecord.masked(example))
    (tmp_path / "x.tfrecord-00000").write_bytes(framed * 2)
    df = tfrecord.read_tfrecords(spark, f"file://{tmp_path}")
    assert [r["features"] for r in df.collect()] == ['{"f": [1.5, -2.0], "i": [5, 150], "t": ["aGk="]}'] * 2
    assert tfrecord.crc32c(b"123456789") == 0xE3069283
    (tmp_path / "x.tfrecord-00000").write_bytes(framed[:-1] + b"?")
    with pytest.raises(Exception, match="damaged"):
        df.collect()


def test_traces(spark, tmp_path):
    rows = [(r, k, 10 - t, t / 2) for r in (1, 2) for k in ("J", "L") for t in range(5)]
    df = spark.createDataFrame(rows, "recording_id long, data_type string, ts_us long, v double")
    traces.write_traces(df, f"file://{tmp_path}/t")
    back = traces.read_traces(spark, f"file://{tmp_path}/t", "recording_id long, data_type string, ts_us long, v double")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    arrays = traces.json_array_traces(df.drop("v"), ["recording_id", "data_type"], "ts_us")
    assert arrays.first()["trace"] == '[{"ts_us":6},{"ts_us":7},{"ts_us":8},{"ts_us":9},{"ts_us":10}]'


def test_late_stop_refines_the_row_only():
    s = router.Source([], [], 0)
    for kind, ts, item in (("start", 100, 1), ("data", 120, 11), ("start", 200, 2), ("stop", 150, 0), ("data", 180, 12), ("data", 250, 13), ("stop", 300, 0)):
        s.take(kind, ts, item)
    assert s.windows == [[1, 100, 200, 150], [2, 200, 300, 300]]
    assert s.release(None) == [(11, 120, 1), (12, 180, 1), (13, 250, 2)]


def test_holdback_and_cancel():
    s = router.Source([], [], 0)
    for kind, ts, item in (("start", 0, 1), ("data", 10, 5), ("data", 90, 6)):
        s.take(kind, ts, item)
    assert s.release(50) == [(5, 10, 1)] and s.held == [[6, 90]]
    s.take("cancel", 95, 0)
    assert s.windows == [] and s.release(None) == []


def _routed(batches, holdback):
    s, out = router.Source([], [], 0), []
    for k, batch in enumerate(batches):
        for kind, ts, item in batch:
            s.offer(kind, ts, item)
        until = None if k == len(batches) - 1 else s.newest - holdback
        s.advance(until)
        out += s.release(until)
    return sorted(out)


def test_starts_and_stops_in_another_batch_count_in_order():
    start_late = [[("start", 0, 1), ("data", 5, 11), ("start", 100, 3)], [("start", 50, 2), ("data", 60, 12), ("data", 120, 13)]]
    assert _routed(start_late, 200) == [(11, 5, 1), (12, 60, 2), (13, 120, 3)]
    stop_late = [[("start", 0, 1), ("start", 100, 2), ("data", 110, 12)], [("stop", 50, 1), ("data", 70, 11)]]
    assert _routed(stop_late, 200) == [(11, 70, None), (12, 110, 2)]


def test_many_windows_and_samples():
    s, n = router.Source([], [], 0), 30_000
    for k in range(n):
        s.take("start", 10 * k, k)
        s.take("stop", 10 * k + 7, k)
        s.take("data", 10 * k + 3 + 5 * (k % 2), k)
    began = time.process_time()
    assert [w for _, _, w in s.release(None)] == [None if k % 2 else k for k in range(n)]
    assert time.process_time() - began < 10


def test_upsert_is_idempotent(spark):
    t = tables.UpsertTable(spark, "k", ["at"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, at long, v long")
    t.apply(batch(("a", 1, 1), ("b", 5, 2)), 0)
    for _ in range(2):
        t.version = 0
        t.apply(batch(("a", 2, 3), ("b", 4, 9)), 1)
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 3), ("b", 5, 2)]


def test_scans(spark, tmp_path):
    spark.range(20).select((F.col("id") % 3).alias("episode_index"), F.col("id").alias("frame_index")).write.parquet(f"file://{tmp_path}/e")
    own = traces.read_episodes(spark, f"file://{tmp_path}/e", [1])
    assert [r["frame_index"] for r in own.collect()] == [1, 4, 7, 10, 13, 16, 19]
    assert [r[0] for r in traces.episode_ids(traces.read_episodes(spark, f"file://{tmp_path}/e")).collect()] == [0, 1, 2]
