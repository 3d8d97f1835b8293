import pytest

from kelpline.operators import sync
from kelpline.plans import catalogue

S = "recording_id long, sensor string, ts_us long, value double"
G = "recording_id long, sensor string, step long, grid_us long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bucket", [1 << 50, 10, 3])
@pytest.mark.parametrize("direction", ["backward", "nearest"])
def test_asof_against_definition(spark, bucket, direction):
    samples = [(1, "a", t, float(v)) for t, v in ((0, 1), (7, 2), (7, 3), (20, 4), (33, 5))] + [(1, "b", 15, None), (1, "b", 2, 9.0), (2, "a", 5, 0.5)]
    grid = [(r, s, k, t) for r, s in ((1, "a"), (1, "b"), (2, "a"), (3, "a")) for k, t in enumerate(range(-4, 50, 3))]
    got = rows(sync.asof(spark.createDataFrame(samples, S), spark.createDataFrame(grid, G), direction, bucket).select("recording_id", "sensor", "step", "src_us", "value"))
    want = []
    for r, s, k, t in grid:
        own = [(ts, v) for a, b, ts, v in samples if (a, b) == (r, s)]
        best = max((x for x in own if x[0] <= t), key=lambda x: (x[0], x[1] or 0), default=None)
        if direction == "nearest":
            ahead = [x for x in own if x[0] > t]
            first = min((x[0] for x in ahead), default=None)
            if first is not None and (best is None or first - t < t - best[0]):
                best = min((x for x in ahead if x[0] == first), key=lambda x: x[1] or 0)
        want.append((r, s, k, *(best or (None, None))))
    assert got == sorted(want)


def shared(spark, n=30, period=50_000):
    return spark.createDataFrame([(r, s, k * period, k / 10) for r in (1, 2) for s in ("joint", "camera") for k in range(n)], S)


def test_ten_hertz(spark):
    out = sync.synchronise(shared(spark), 100_000, max_delay_us=1_000_000)
    assert out.select("recording_id").distinct().count() == 2 and out.where("src_us is null").count() == 0


@pytest.mark.parametrize(("options", "message"), [
    ({"period_us": 1000, "allow_duplicates": False, "max_delay_us": 1_000_000}, "too sparse"),
    ({"period_us": 1000, "max_delay_us": 0}, "within max delta"),
    ({"period_us": 1000, "allow_duplicates": False, "max_delay_us": 0}, "within max delta"),
])
def test_failures(spark, options, message):
    with pytest.raises(Exception, match=message):
        sync.synchronise(shared(spark), **options).collect()


def test_unknown_sensor(spark):
    with pytest.raises(ValueError, match="No sensors found for data type"):
        sync.synchronise(shared(spark), 100_000, sensors=["joint", "sonar"])
    with pytest.raises(ValueError):
        sync.periodic_grid(sync.bounds(shared(spark)), -1)


def test_trimming(spark):
    df = spark.createDataFrame([(1, "a", t, 0.0) for t in range(0, 50, 10)] + [(1, "b", t, 0.0) for t in range(15, 80, 10)], S)
    assert rows(sync.bounds(df, trim=True)) == [(1, 15, 40)] and rows(sync.bounds(df)) == [(1, 0, 75)]


def test_no_movement(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 1, 1.05), (1, "b", 0, 5.0), (1, "b", 2, 5.2), (1, "a", 3, 1.0), (2, "a", 0, 1.0), (2, "a", 9, 1.0)], S)
    assert rows(sync.moved_from_start(df, 0.1)) == [(1, "a", 3, 1.0), (1, "b", 2, 5.2)]


def test_empty(spark):
    none = spark.createDataFrame([], S)
    assert sync.synchronise(none, 1000).count() == 0 and sync.synchronise(none, None).count() == 0


@pytest.mark.parametrize("bucket", [1 << 50, 10, 3])
@pytest.mark.parametrize("direction", ["backward", "nearest"])
@pytest.mark.parametrize("trim", [False, True])
def test_periodic_is_asof_of_its_cells(spark, monkeypatch, bucket, direction, trim):
    monkeypatch.setattr(sync, "STEPS", 4)
    samples = [(1, "a", t, float(v)) for t, v in ((0, 1), (7, 2), (7, 3), (20, 4), (90, 5))] + [(1, "b", 15, None), (1, "b", 2, 9.0), (1, "b", 40, 1.0), (1, "c", None, 1.0), (2, "a", 5, 0.5), (2, "b", -9, 1.5)]
    s = spark.createDataFrame(samples, S)
    clock = sync.bounds(s, trim)
    want = sync.asof(s, sync.for_each_sensor(sync.periodic_grid(clock, 3), s), direction, bucket)
    key = lambda df: sorted((tuple(r) for r in df.where("sensor <> 'c'").collect()), key=str)
    got = sync.periodic(s, clock, 3, direction, bucket)
    assert key(got) == key(want)
    timeless = [(r["src_us"], r["value"]) for r in got.where("sensor = 'c'").collect()]
    assert timeless == [(None, None)] * want.where("sensor = 'c'").count()


def test_steps_of_a_first_use_only(spark):
    rows_ = [(1, "a", k, 10 * k, src, v) for k, src, v in ((0, None, None), (1, 5, 1.0), (2, 5, 1.0), (3, 28, None), (4, 28, None), (5, 50, 2.0))]
    df = spark.createDataFrame(rows_, G + ", src_us long, value double")
    assert rows(sync.without_duplicates(df)) == [rows_[1], rows_[3], rows_[5]]


@pytest.mark.parametrize(("name", "shuffles"), [("sync_asof_nearest", 0), ("sync_max_delay", 0), ("sync_no_duplicates", 1), ("sync_wide", 1)])
def test_cells_are_made_after_the_shuffles(spark, sf_dir, name, shuffles):
    """A step of every sensor is many times the samples: it is not dealt out, sorted and joined, and summed up once at most."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert above.count("Exchange") <= shuffles and "Window" not in above and "Join" not in above
