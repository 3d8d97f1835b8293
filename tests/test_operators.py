import pytest
from pyspark.sql import functions as F

from kelpline.functions import checks, images, poses, scalars, scaling
from kelpline.operators import datasets, embodiment, episodes, importing, merging, routing, state, stats


def values(df, *columns):
    return [tuple(r) for r in df.orderBy(*columns[:1]).select(*columns).collect()]


def one(spark, column, schema="x double", row=(0.0,)):
    return spark.createDataFrame([row], schema).select(column.alias("y")).first()["y"]


# ---------------------------------------------------------------- windows


def frames(spark, n=10):
    return spark.createDataFrame([("e", k, float(k)) for k in range(n)], "ep string, t long, v double")


@pytest.mark.parametrize(("target", "pad", "at", "want"), [(True, True, 4, [4, 5, 6]), (False, True, 4, [5, 6, 7]), (False, True, 8, [9, 9, 9]), (True, True, 8, [8, 9, 9]), (False, True, 9, []), (False, False, 8, [9])])
def test_action_chunks(spark, target, pad, at, want):
    out = episodes.action_chunks(frames(spark), ["ep"], ["t"], "v", 3, target, pad)
    assert dict(values(out, "t", "chunk"))[at] == want


def test_chunks_keep_nulls(spark):
    df = spark.createDataFrame([("e", 0, 1.0), ("e", 1, None), ("e", 2, 3.0)], "ep string, t long, v double")
    assert dict(values(episodes.action_chunks(df, ["ep"], ["t"], "v", 2, True), "t", "chunk")) == {0: [1.0, None], 1: [None, 3.0], 2: [3.0, 3.0]}


@pytest.mark.parametrize(("positions", "targets", "want"), [
    ({"j1": [1, 2, 3]}, {"j1": [2, 3, 999]}, True), ({"j1": [1, 2, 3]}, {"j1": [0, 9, 2]}, False),
    ({"j1": [1, 2, 3], "j2": [10, 11, 12]}, {"j1": [2, 3, 999], "j2": [11, 12, 999]}, True),
    ({"j1": [1, 2, 3], "j2": [10, 11, 12]}, {"j1": [2, 3, 999], "j2": [11, 99, 999]}, False),
    ({"j1": [1, 2, 3]}, {"j1": [None] * 3}, True), ({"j1": [0, 1e5, 0]}, {"j1": [1e5 + 0.5, 0, 0]}, True), ({"j1": [0, 0, 0]}, {"j1": [2e-6, 0, 0]}, False),
])
def test_redundant_targets(spark, positions, targets, want):
    rows = [("e", j, k, float(p), None if t is None else float(t)) for j in positions for k, (p, t) in enumerate(zip(positions[j], targets[j], strict=True))]
    df = spark.createDataFrame(rows, "ep string, joint string, t long, position double, target double")
    assert values(episodes.redundant_targets(df, "ep", "joint", ["t"]), "ep", "redundant") == [("e", want)]


@pytest.mark.parametrize(("start", "stop", "step"), [(None, None, 1), (2, 7, 2), (-3, None, 1), (None, -2, 3), (5, 2, 1), (-99, 99, 4)])
def test_positional_is_pythons_slice(spark, start, stop, step):
    out = episodes.positional(frames(spark), ["ep"], ["t"], start, stop, step)
    assert [r[0] for r in values(out, "t")] == list(range(10))[start:stop:step]


def test_element(spark):
    assert episodes.element(frames(spark), ["ep"], ["t"], -1).first()["t"] == 9
    with pytest.raises(Exception, match="out of range"):
        episodes.element(frames(spark), ["ep"], ["t"], 10).collect()


def test_split_sizes_are_exact(spark):
    df = spark.range(103)
    a, b = (sorted(map(tuple, episodes.train_validation_split(df, "id", 0.3, s).collect())) for s in (1, 2))
    assert sum(x[1] == "train" for x in a) == int(0.7 * 103) and a != b and len(a) == 103


def test_step_clock_counts_skipped_steps(spark):
    out = episodes.step_clock(frames(spark, 4), ["ep"], ["t"], F.lit(100), 10, F.col("t") != 1)
    assert values(out, "t", "step_us", "stop_us") == [(0, 110, 150), (2, 130, 150), (3, 140, 150)]


# ---------------------------------------------------------------- merging

POINTS = "arg int, point_us long, data_type string, label string, value double"


@pytest.mark.parametrize(("points", "want"), [
    ([], []), ([(0, 1, "g", "arm", 0.5), (1, 3, "g", "arm", 0.9)], [("arm", 0.9, 3)]), ([(1, 1, "g", "arm", 0.5), (0, 3, "g", "arm", 0.9)], [("arm", 0.9, 3)]),
    ([(0, 1, "g", "l", 0.5), (1, 2, "g", "r", 0.7)], [("l", 0.5, 2), ("r", 0.7, 2)]), ([(0, 1, "g", "arm", 0.5), (1, 1, "g", "arm", 0.9)], [("arm", 0.9, 1)]),
    ([(0, 1, "g", "arm", 0.5), (1, 2, "g", "arm", None)], [("arm", None, 2)]),
])
def test_merge_points(spark, points, want):
    assert values(merging.merge_points(spark.createDataFrame(points, POINTS)), "label", "value", "merged_us") == want


def test_fold_guards_terminal_states(spark):
    u = [("a", 1, "progress", 5), ("a", 2, "written", 7), ("a", 3, "fail", 9), ("b", 1, "fail", 1), ("b", 2, "written", 2), ("c", 1, "progress", 3)]
    out = merging.fold_states(spark.createDataFrame(u, "k string, at int, kind string, bytes int"), "k", ["at"])
    assert values(out, "k", "status", "bytes") == [("a", "written", 7), ("b", "failed", 1), ("c", "writing", 3)]


# ---------------------------------------------------------------- routing

DATA, WINDOWS = "row_id long, source string, ts long", "window_id long, source string, start long, stop long"


def routed(spark, data, windows, **options):
    return dict(values(routing.route(spark.createDataFrame(data, DATA), spark.createDataFrame(windows, WINDOWS), **options), "row_id", "window_id"))


@pytest.mark.parametrize("options", [{}, {"slot_us": 7}, {"slot_us": 1000}])
def test_routing_rules(spark, options):
    data = [(1, "a", 99), (2, "a", 100), (3, "a", 199), (4, "a", 200), (5, "a", 900), (6, "b", 150), (7, "a", 160), (8, "c", 1)]
    windows = [(1, "a", 100, 200), (2, "a", 150, None), (3, "a", 155, 170), (9, "b", 0, 0)]
    assert routed(spark, data, windows, **options) == {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: None, 7: 3, 8: None}


def test_orphans_are_what_routing_leaves_out(spark):
    d, w = spark.createDataFrame([(1, "a", 5), (2, "a", 15), (3, "b", 5)], DATA), spark.createDataFrame([(1, "a", 0, 10)], WINDOWS)
    assert [r[0] for r in values(routing.orphans(d, w), "row_id")] == [2, 3]


@pytest.mark.parametrize(("bound", "kept"), [(25, 3), (20, 2), (0, 0), (99, 5)])
def test_straddle_cut(spark, bound, kept):
    df = spark.createDataFrame([("c", k, o, bound) for k, o in enumerate([0, 10, 20, 30, 5])], "chunk string, k int, offset long, bound long")
    assert routing.straddle_cut(df, "chunk", "k", "offset", "bound").count() == kept


def test_no_offsets_keep_the_chunk(spark):
    df = spark.createDataFrame([("c", k, None, 5) for k in range(3)], "chunk string, k int, offset long, bound long")
    assert routing.straddle_cut(df, "chunk", "k", "offset", "bound").count() == 3


# ------------------------------------------------------------------ state


def test_claim_waits_for_number_or_age(spark):
    df = spark.createDataFrame([(k, 100 + k) for k in range(5)], "id long, updated long")
    assert state.claim_oldest(df, "updated", "id", 3, now=110, least_age=1000).count() == 3
    assert state.claim_oldest(df, "updated", "id", 9, now=110, least_age=1000).count() == 0
    assert state.claim_oldest(df, "updated", "id", 9, now=1100, least_age=1000).count() == 5


def test_lookup_and_merge(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "recording_id long, name string")
    assert datasets.merged(df, df).count() == 2 and datasets.lookup(df, "name", "z", missing_ok=True).count() == 0
    with pytest.raises(LookupError):
        datasets.lookup(df, "name", "z")


# ------------------------------------------------------------- embodiment


def test_strict_projection(spark):
    layout = spark.createDataFrame([("a", 0), ("b", 4)], "sensor string, slot int")
    full = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "z", 3.0)], "step long, sensor string, value double")
    assert values(embodiment.project_strict(full, layout, ["step"]), "slot", "value") == [(0, 1.0), (4, 2.0)]
    with pytest.raises(Exception, match="missing"):
        embodiment.project_strict(full.where("sensor <> 'b'"), layout, ["step"]).collect()


def test_mask_and_width(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 2, 0.0)], "step long, slot int, value double")
    assert values(embodiment.masked(df, 4, ["step"]), "step", "values", "mask") == [(1, [5.0, 0.0, 0.0, 0.0], [1.0, 0.0, 1.0, 0.0])]
    assert embodiment.slot_width(df, ["step"]).first()["width"] == 3
    with pytest.raises(Exception, match="more slots"):
        embodiment.masked(df, 2, ["step"]).collect()


def test_metric_average_divides_by_reporting_steps(spark):
    df = spark.createDataFrame([(0, "a", 4.0), (1, "b", 2.0)], "step long, key string, value double")
    assert values(stats.metric_average(df), "key", "average") == [("a", 2.0), ("b", 1.0)]


# -------------------------------------------------------------- importing


def test_mappings():
    got = importing.mappings([{"source_name": "/camera/color.image.data"}, {"source_name": "x.y", "source": "/t"}])
    assert [(m["topic"], m["path"]) for m in got] == [("/camera/color", ["image", "data"]), ("/t", ["x", "y"])]
    with pytest.raises(ValueError):
        importing.mappings([{"source_name": "x"}])


def test_paths_and_kinds(spark):
    text = '{"outer":{"values":[{"x":1},{"x":2}]}}'
    assert one(spark, importing.json_path(F.lit(text), ["outer", "values", 1, "x"])) == "2"
    assert [importing.dataset_kind(n) for n in (["a/b.mcap", "dataset_info.json"], ["dataset_info.json", "x.tfrecord-0"], ["d/meta/info.json"], ["features.json"], ["x"])] == ["mcap", "rlds", "lerobot", "tfds", None]
    with pytest.raises(ValueError):
        importing.split_pose(F.array(), (0, 3), None)


@pytest.mark.parametrize(("mode", "want"), [("step", [1, 3, 4]), ("episode", [4])])
def test_skip_on_error(spark, mode, want):
    df = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", None), (4, "b", False)], "id long, ep string, bad boolean")
    assert [r[0] for r in values(importing.skip_on_error(df, "ep", F.col("bad"), mode), "id")] == want
    with pytest.raises(Exception, match="a step failed"):
        importing.skip_on_error(df, "ep", F.col("bad"), "all").collect()


# -------------------------------------------------------- column functions


def test_scaling(spark):
    lit = F.lit
    assert [one(spark, scaling.zscore(lit(x), lit(5.0), lit(2.0))) for x in (5.0, 7.0, 3.0)] == [0, 1, -1]
    assert abs(one(spark, scaling.zscore(lit(1.0), lit(0.0), lit(1e-10)))) == pytest.approx(1e6)
    assert one(spark, scaling.un_zscore(lit(3.0), lit(1.0), lit(0.0))) == 1.0
    assert one(spark, scaling.quantile(lit(99.0), lit(0.0), lit(1.0))) == 1.0 and one(spark, scaling.un_quantile(lit(-7.0), lit(2.0), lit(4.0))) == 2.0


def test_checks_treat_nan_as_the_rules_say(spark):
    nan, lit = F.lit(float("nan")), F.lit
    assert one(spark, checks.joint_position(nan, lit(0.0), lit(1.0))) is None and one(spark, checks.joint_position(lit(1.0 + 5e-7), lit(0.0), lit(1.0))) is None
    assert one(spark, checks.joint_position(lit(1.1), lit(0.0), lit(1.0))) and one(spark, checks.joint_position(lit(9.0), lit(None).cast("double"), lit(None).cast("double"))) is None
    assert one(spark, checks.joint_magnitude(nan, lit(1.0))) is None and one(spark, checks.gripper(nan))
    pose = lambda *q: F.array(*map(lit, (0.0, 0.0, 0.0, *q)))
    assert one(spark, checks.unit_quaternion(pose(0.0, 0.0, 0.0, 1.00005))) is None and one(spark, checks.unit_quaternion(pose(0.0, 0.0, 0.0, 1.001)))


@pytest.mark.parametrize(("text", "want"), [("10gb", 10 << 30), (" 1.5 MB", 3 << 19), ("512", 512), ("0", None), ("x", None), ("5pb", None), ("-1kb", None)])
def test_size(spark, text, want):
    assert one(spark, scalars.size_in_bytes(F.lit(text))) == want


def test_depth(spark):
    rgb = scalars.level_to_rgb(scalars.depth_to_level(F.col("x")))
    for x in (0.0, 0.37, 9.9999, 10.0, 12.0, float("nan"), -1.0):
        want = 0.0 if x != x else min(max(x, 0), 10)
        assert one(spark, scalars.rgb_to_depth(*rgb), row=(x,)) == pytest.approx(want, abs=1e-4)
    assert [one(spark, scalars.clip_depth(F.lit(x))) for x in (float("nan"), float("inf"), float("-inf"))] == [0.0, 10.0, 0.0]


def test_next_free_name(spark):
    taken = spark.createDataFrame([("run",), ("run_1",), ("run_3",), ("other_2",)], "name string")
    wanted = spark.createDataFrame([("run",), ("other",), ("new",), ("run_1",)], "name string")
    assert dict(values(scalars.next_free_name(taken, wanted), "name", "free_name")) == {"run": "run_2", "other": "other", "new": "new", "run_1": "run_1_1"}


def test_labels_and_uuid(spark):
    assert one(spark, scalars.label_type(F.lit("RGB:a:b"))) == "RGB" and one(spark, scalars.label_name(F.lit("RGB:a:b"))) == "a:b"
    assert one(spark, scalars.is_uuid(F.lit("123E4567-e89b-12d3-a456-426614174000"))) and not one(spark, scalars.is_uuid(F.lit("123e4567")))


def test_poses_against_numpy(spark):
    import numpy as np

    def matrix(p):
        x, y, z, w = p[3:]
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = r, p[:3]
        return m

    rng = np.random.default_rng(0)
    a, b = (np.concatenate([rng.normal(size=3), q / np.linalg.norm(q)]) for q in rng.normal(size=(2, 4)))
    lit = lambda v: F.array(*map(F.lit, map(float, v)))
    assert np.allclose(matrix(one(spark, poses.compose(lit(a), lit(b)))), matrix(a) @ matrix(b))
    assert np.allclose(matrix(one(spark, poses.from_matrix(lit(matrix(a).ravel())))), matrix(a))
    c, s = np.cos(0.3), np.sin(0.3)
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    for column in (poses.from_euler(lit([0, 0, 0, 0, 0, 0.3])), poses.from_axis_angle(lit([0, 0, 0, 0, 0, 0.3]))):
        assert np.allclose(matrix(one(spark, column))[:3, :3], turn)
    assert one(spark, poses.forward(lit([0.0, np.pi / 2]), [(1.0, 0.0), (2.0, 0.0)])) == pytest.approx([1.0, 2.0, np.pi / 2])


def test_images():
    import numpy as np

    raw = bytes(range(12)) + b"\0\0"
    assert images.raw_pixels(raw[:7] * 2, 2, 2, 7, "bgr8")[0, 0].tolist() == [2, 1, 0]
    with pytest.raises(ValueError):
        images.raw_pixels(raw, 2, 2, 6, "rgb8")
    square = np.full((4, 8, 3), 9, dtype=np.uint8)
    out = images.resized(square, 4, 4)
    assert out.shape == (4, 4, 3) and out[0].max() == 0 and out[1:3].min() == 9
    assert images.depth_colours(np.array([0.0, 15.0, 1.0]))[0].tolist() == [0, 0, 0]


def test_upsert_table_goes_on_after_a_restart(spark, tmp_path):
    """A new process, a batch that runs again and a version left half written change nothing."""
    from kelpline.streaming.tables import UpsertTable

    root, ddl = f"file://{tmp_path}/table", "k long, at long, v string"
    batch = lambda *rows: spark.createDataFrame(list(rows), ddl)
    first = UpsertTable(spark, "k", ["at"], root)
    assert first.read() is None
    first.apply(batch((1, 1, "a"), (2, 1, "b")), 0)
    first.apply(batch((1, 2, "c")), 1)
    (tmp_path / "table" / "v2").mkdir()  # a failed write: no mark of success
    again = UpsertTable(spark, "k", ["at"], root)
    again.apply(batch((1, 9, "x")), 1)  # seen before
    again.apply(batch((3, 1, "d"), (2, 0, "old")), 2)
    again.apply(batch((3, 2, "e")), 3)
    assert sorted(map(tuple, UpsertTable(spark, "k", ["at"], root).read().collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 2, "e")]
    assert again.versions() == [2, 3]


def test_upsert_table_follows_a_stream_that_stops_and_starts(spark, tmp_path):
    from kelpline.streaming.tables import UpsertTable, replay

    root, source, ddl = f"file://{tmp_path}/table", f"{tmp_path}/in", "k long, at long, v string"
    for turn, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        UpsertTable(spark, "k", ["at"], root).follow(replay(spark, source, ddl)).awaitTermination()
    assert sorted(map(tuple, UpsertTable(spark, "k", ["at"], root).read().collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_split_ranks_only_the_prefix_of_the_cut(spark):
    from kelpline.operators import episodes

    rows = spark.range(5000)
    out = episodes.train_validation_split(rows, "id", 0.3, 7)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"train": 3500, "validation": 1500}
    h = {r["id"]: r["h"] for r in rows.selectExpr("id", "md5(concat(cast(id as string), ':7')) as h").collect()}
    train = {i for i in sorted(h, key=lambda i: (h[i], i))[:3500]}
    assert {r["id"] for r in out.where("split = 'train'").collect()} == train
