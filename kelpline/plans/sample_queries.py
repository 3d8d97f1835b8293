"""Statistics, normalisation, windows and merging over events as samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import scaling
from kelpline.operators import episodes, merging, stats
from kelpline.plans.registry import SAMPLES_SQL, micros, query, samples, table

_STATS = f"""{SAMPLES_SQL}, stats AS (
  SELECT sensor, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high,
         quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM samples GROUP BY sensor)"""


@query("dataset_statistics", f'WITH {_STATS} SELECT sensor, n AS count, round(mean, 6) AS mean, round(std, 6) AS std, low AS "min", high AS "max", round(q01, 6) AS q01, round(q99, 6) AS q99 FROM stats')
def dataset_statistics(spark, sf_dir):
    s = stats.dataset_statistics(samples(spark, sf_dir), ["sensor"])
    return s.select("sensor", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", "max", *(F.round(c, 6).alias(c) for c in ("q01", "q99")))


@query(
    "vector_statistics",
    """WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS elem, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT label, elem::INT AS elem, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS "min", max(value) AS "max",
       round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.99), 6) AS q99 FROM e GROUP BY label, elem""",
)
def vector_statistics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    s = stats.vector_statistics(v, ["label"], "embedding")
    return s.select("label", "elem", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", "max", *(F.round(c, 6).alias(c) for c in ("q01", "q99")))


@query("stats_concatenation", """WITH o AS (SELECT o_orderstatus AS kind, o_orderpriority AS slot, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY ALL)
SELECT kind, array_to_string(list(high ORDER BY slot), ';') AS highs, array_to_string(list(low ORDER BY slot), ';') AS lows FROM o GROUP BY kind""")
def stats_concatenation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("slot")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    c = stats.concatenated(o, ["kind"], "slot", ["high", "low"])
    return c.select("kind", F.array_join(F.col("high").cast("array<string>"), ";").alias("highs"), F.array_join(F.col("low").cast("array<string>"), ";").alias("lows"))


def _scaled(name: str, spark_value, sql_value: str) -> None:
    sql = f"WITH {_STATS} SELECT recording_id, sensor, ts_us, round({sql_value}, 6) AS value FROM samples JOIN stats USING (sensor)"

    @query(name, sql)
    def run(spark, sf_dir):
        own = samples(spark, sf_dir)
        s = stats.dataset_statistics(own, ["sensor"])
        met = own.join(F.broadcast(s), "sensor")  # a row a sensor
        return met.select("recording_id", "sensor", "ts_us", F.round(spark_value(), 6).alias("value"))


_Z = "(value - mean) / greatest(std, 1e-6)"
_M = "2 * (value - low) / greatest(high - low, 1e-6) - 1"
_Q = "least(greatest(2 * (value - q01) / greatest(q99 - q01, 1e-6) - 1, -1.0), 1.0)"
_c = F.col
_scaled("normalize_zscore", lambda: scaling.zscore(_c("value"), _c("mean"), _c("std")), _Z)
_scaled("normalize_minmax", lambda: scaling.minmax(_c("value"), _c("min"), _c("max")), _M)
_scaled("normalize_quantile", lambda: scaling.quantile(_c("value"), _c("q01"), _c("q99")), _Q)
_scaled("unnormalize_zscore", lambda: scaling.un_zscore(scaling.zscore(_c("value"), _c("mean"), _c("std")), _c("mean"), _c("std")), f"({_Z}) * std + mean")
_scaled("unnormalize_minmax", lambda: scaling.un_minmax(scaling.minmax(_c("value"), _c("min"), _c("max")), _c("min"), _c("max")), f"(({_M}) + 1) / 2 * (high - low) + low")
_scaled("unnormalize_quantile", lambda: scaling.un_quantile(scaling.quantile(_c("value"), _c("q01"), _c("q99")), _c("q01"), _c("q99")), f"(({_Q}) + 1) / 2 * greatest(q99 - q01, 1e-6) + q01")

# ------------------------------------------------------------------ windows

_LINE = "PARTITION BY recording_id ORDER BY ts_us, event_id"
_FRAMES = "frames AS (SELECT user_id AS recording_id, event_type AS sensor, epoch_us(ts) AS ts_us, event_id, value FROM events)"


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("sensor"), micros(F.col("ts")).alias("ts_us"), "event_id", "value")


def _joined(c):
    return F.array_join(F.transform(c, lambda v: F.format_string("%.2f", v)), ";")


def _chunk_sql(first: int, pad: bool) -> str:
    last = "list_concat(c, list_resize([]::DOUBLE[], CASE WHEN len(c) > 0 THEN 4 - len(c) ELSE 0 END, c[-1]))" if pad else "c"
    return f"""WITH {_FRAMES}, w AS (SELECT recording_id, event_id, coalesce(list(value) OVER ({_LINE} ROWS BETWEEN {first} FOLLOWING AND {first + 3} FOLLOWING), []) AS c FROM frames)
SELECT recording_id, event_id, array_to_string(list_transform({last}, lambda v: printf('%.2f', v)), ';') AS chunk FROM w"""


def _chunks(name, target, pad):
    @query(name, _chunk_sql(0 if target else 1, pad))
    def run(spark, sf_dir):
        c = episodes.action_chunks(_frames(spark, sf_dir), ["recording_id"], ["ts_us", "event_id"], "value", 4, target, pad)
        return c.select("recording_id", "event_id", _joined(F.col("chunk")).alias("chunk"))


_chunks("action_chunks_target", True, False)
_chunks("action_chunks_next", False, False)
_chunks("chunk_padding", False, True)


@query("episode_offsets", "WITH n AS (SELECT user_id AS recording_id, count(*) - 1 AS samples FROM events GROUP BY 1) SELECT recording_id, samples, coalesce(sum(samples) OVER (ORDER BY recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_sample FROM n")
def episode_offsets(spark, sf_dir):
    return episodes.episode_offsets(_frames(spark, sf_dir), "recording_id")


@query("drop_last_frame", f"WITH {_FRAMES} SELECT * FROM frames QUALIFY lead(1) OVER ({_LINE}) IS NOT NULL")
def drop_last_frame(spark, sf_dir):
    return episodes.drop_last_frame(_frames(spark, sf_dir), ["recording_id"], ["ts_us", "event_id"])


@query("training_row_count", "SELECT count(*) - count(DISTINCT user_id) AS training_rows FROM events")
def training_row_count(spark, sf_dir):
    return _frames(spark, sf_dir).agg((F.count(F.lit(1)) - F.count_distinct("recording_id")).alias("training_rows"))


_JOINTS = """joints AS (SELECT l_suppkey AS episode, l_linenumber AS joint, l_orderkey AS step, l_quantity AS position,
  CASE WHEN l_suppkey % 2 = 0 THEN lead(l_quantity) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) + CASE WHEN l_suppkey % 4 = 0 THEN 1e-7 ELSE 0 END
       ELSE l_quantity END AS target, l_partkey, l_extendedprice FROM lineitem)"""


@query(
    "redundant_target_check",
    f"""WITH {_JOINTS}, f AS (SELECT *, lead(position) OVER (PARTITION BY episode, joint ORDER BY step, l_partkey, l_extendedprice) AS following FROM joints)
SELECT episode, coalesce(bool_and(abs(following - target) <= 1e-6 + 1e-5 * abs(target)) FILTER (following IS NOT NULL AND target IS NOT NULL), true) AS redundant FROM f GROUP BY episode""",
)
def redundant_target_check(spark, sf_dir):
    from pyspark.sql.window import Window

    order = ["step", "l_partkey", "l_extendedprice"]
    j = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("episode"), F.col("l_linenumber").alias("joint"), F.col("l_orderkey").alias("step"), F.col("l_quantity").alias("position"), "l_partkey", "l_extendedprice")
    following = F.lead("position").over(Window.partitionBy("episode", "joint").orderBy(*order)) + F.when(F.col("episode") % 4 == 0, 1e-7).otherwise(0.0)
    j = j.withColumn("target", F.when(F.col("episode") % 2 == 0, following).otherwise(F.col("position")))
    return episodes.redundant_targets(j, "episode", "joint", order)


@query("monotonic_check", """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS ts_us, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)
SELECT * FROM o WHERE ts_us <= previous""")
def monotonic_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros(F.col("o_orderdate")).alias("ts_us"))
    return episodes.monotonic_violations(o, ["o_custkey"], ["o_orderkey"], "ts_us")


@query("step_clock", f"""WITH {_FRAMES}, s AS (SELECT recording_id, event_id, value, 1000000 + row_number() OVER ({_LINE}) * 50000 AS step_us FROM frames)
SELECT recording_id, event_id, step_us, max(step_us) OVER (PARTITION BY recording_id) + 50000 AS stop_us FROM s WHERE value < 100""")
def step_clock(spark, sf_dir):
    c = episodes.step_clock(_frames(spark, sf_dir), ["recording_id"], ["ts_us", "event_id"], F.lit(1_000_000).cast("long"), 50_000, F.col("value") < 100)
    return c.select("recording_id", "event_id", "step_us", "stop_us")


@query("relative_clock", """SELECT user_id AS recording_id, event_id, 5000000 + greatest(0, epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) AS relative_us FROM events""")
def relative_clock(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("arrival", F.col("event_id"))
    return episodes.relative_clock(f, ["recording_id"], "ts_us", F.lit(5_000_000).cast("long")).select("recording_id", "event_id", "relative_us")


@query("frame_index", f"WITH {_FRAMES} SELECT recording_id, event_id, row_number() OVER ({_LINE}) - 1 AS frame_idx FROM frames")
def frame_index(spark, sf_dir):
    return episodes.frame_index(_frames(spark, sf_dir), ["recording_id"], ["ts_us", "event_id"]).select("recording_id", "event_id", "frame_idx")


@query("positional_slice", f"""WITH {_FRAMES}, p AS (SELECT recording_id, event_id, row_number() OVER ({_LINE}) - 1 AS "at", count(*) OVER (PARTITION BY recording_id) AS n FROM frames)
SELECT recording_id, event_id, "at" FROM p WHERE "at" >= greatest(n - 20, 0) AND "at" < greatest(n - 2, 0) AND ("at" - greatest(n - 20, 0)) % 3 = 0""")
def positional_slice(spark, sf_dir):
    return episodes.positional(_frames(spark, sf_dir), ["recording_id"], ["ts_us", "event_id"], -20, -2, 3).select("recording_id", "event_id", "at")


@query("tfds_split_slice", """WITH s AS (SELECT c_nationkey AS ord, c_nationkey::VARCHAR AS split, count(*) AS size FROM customer GROUP BY c_nationkey),
p AS (SELECT split, size, sum(size) OVER (ORDER BY ord) AS e FROM s), q AS (SELECT split, size, e, e - size AS b FROM p)
SELECT split, greatest(25 - b, 0)::BIGINT AS from_row, least(90 - b, size)::BIGINT AS to_row FROM q WHERE b < 90 AND e > 25""")
def tfds_split_slice(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("ord")).agg(F.count(F.lit(1)).alias("size")).withColumn("split", F.col("ord").cast("string"))
    return episodes.split_ranges(s, 25, 90)


@query("contiguous_partition", "WITH p AS (SELECT c_custkey, c_custkey - (SELECT min(c_custkey) FROM customer) AS place FROM customer) SELECT c_custkey, least(place // greatest(count(*) OVER () // 7, 1), 6) AS part FROM p")
def contiguous_partition(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    low, n = c.agg(F.min("c_custkey"), F.count(F.lit(1))).first()
    return episodes.contiguous_parts(c.withColumn("at", F.col("c_custkey") - low), "at", 7, n).select("c_custkey", "part")


@query("train_val_split", """WITH h AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR || ':7') AS h FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h, o_orderkey) <= floor((1.0::DOUBLE - 0.2::DOUBLE) * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM h""")
def train_val_split(spark, sf_dir):
    return episodes.train_validation_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2, 7)


@query("random_timestep", """WITH n AS (SELECT user_id AS recording_id, count(*) AS length FROM events GROUP BY 1)
SELECT recording_id, length, ('0x' || substr(md5(recording_id::VARCHAR || ':3'), 1, 8))::BIGINT % greatest(length - 1, 1) AS timestep FROM n""")
def random_timestep(spark, sf_dir):
    n = _frames(spark, sf_dir).groupBy("recording_id").agg(F.count(F.lit(1)).alias("length"))
    return episodes.random_timestep(n, "recording_id", "length", 3)


# ------------------------------------------------------------------ merging


@query("merge_sync_points", """WITH p AS (SELECT user_id % 3 AS arg, epoch_us(date_trunc('day', ts)) AS point_us, event_type AS data_type, (user_id % 20)::VARCHAR AS label, event_id AS value FROM events),
l AS (SELECT data_type, label, arg_max(value, {'a': point_us, 'b': arg, 'c': value}) AS value FROM p GROUP BY data_type, label)
SELECT data_type, label, value, (SELECT max(point_us) FROM p) AS merged_us FROM l""")
def merge_sync_points(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # several events of a point share a label: the one with the greatest id is the point's value
    p = e.select((F.col("user_id") % 3).alias("arg"), micros(F.date_trunc("day", "ts")).alias("point_us"), F.col("event_type").alias("data_type"), (F.col("user_id") % 20).cast("string").alias("label"), F.col("event_id").alias("value"))
    p = p.groupBy("arg", "point_us", "data_type", "label").agg(F.max("value").alias("value"))
    return merging.merge_points(p)


@query("latest_per_stream", f"WITH {_FRAMES} SELECT recording_id, sensor, arg_max(value, {{'a': ts_us, 'b': event_id}}) AS value, max(ts_us) AS ts_us FROM frames GROUP BY ALL")
def latest_per_stream(spark, sf_dir):
    return merging.latest_per_stream(_frames(spark, sf_dir), ["recording_id", "sensor"], ["ts_us", "event_id"], ["value", "ts_us"])


@query("availability_delta", """SELECT user_id AS recording_id, (event_id % 7)::BIGINT AS track FROM events GROUP BY ALL
HAVING arg_max(event_type, {'a': epoch_us(ts), 'b': event_id}) <> 'error'""")
def availability_delta(spark, sf_dir):
    f = _frames(spark, sf_dir).select("recording_id", (F.col("event_id") % 7).alias("track"), "ts_us", "event_id", F.when(F.col("sensor") == "error", "remove").otherwise("add").alias("event"))
    return merging.availability(f, ["recording_id", "track"], ["ts_us", "event_id"])


@query("status_coalesce", """SELECT l_orderkey, arg_max(l_quantity, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice}) AS bytes, bool_or(l_linestatus = 'F') AS completed FROM lineitem GROUP BY l_orderkey""")
def status_coalesce(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("bytes"), (F.col("l_linestatus") == "F").alias("completed"))
    return merging.coalesced_status(r, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("state_fold_guarded", f"""WITH {_FRAMES}, u AS (SELECT recording_id, {{'a': ts_us, 'b': event_id}} AS moment, CASE WHEN event_id % 41 = 0 THEN 'fail' WHEN event_id % 37 = 0 THEN 'written' ELSE 'progress' END AS kind, value AS bytes FROM frames),
f AS (SELECT recording_id, arg_min(kind, moment) AS final, min(moment) AS since FROM u WHERE kind <> 'progress' GROUP BY 1)
SELECT u.recording_id, CASE any_value(f.final) WHEN 'written' THEN 'written' WHEN 'fail' THEN 'failed' ELSE 'writing' END AS status, arg_max(u.bytes, u.moment) AS bytes
FROM u LEFT JOIN f ON u.recording_id = f.recording_id WHERE f.since IS NULL OR u.moment <= f.since GROUP BY u.recording_id""")
def state_fold_guarded(spark, sf_dir):
    kind = F.when(F.col("event_id") % 41 == 0, "fail").when(F.col("event_id") % 37 == 0, "written").otherwise("progress")
    u = _frames(spark, sf_dir).select("recording_id", "ts_us", "event_id", kind.alias("kind"), F.col("value").alias("bytes"))
    return merging.fold_states(u, "recording_id", ["ts_us", "event_id"])


@query("first_write_wins", f"""WITH {_FRAMES} SELECT recording_id, min(ts_us) FILTER (sensor = 'signup') AS started_us, min(ts_us) FILTER (sensor = 'error') AS failed_us FROM frames GROUP BY 1""")
def first_write_wins(spark, sf_dir):
    u = _frames(spark, sf_dir).select("recording_id", "ts_us", "event_id", F.when(F.col("sensor") == "signup", F.col("ts_us")).alias("started_us"), F.when(F.col("sensor") == "error", F.col("ts_us")).alias("failed_us"))
    return merging.stamped_first(u, "recording_id", ["ts_us", "event_id"], ["started_us", "failed_us"])


# ------------------------------------------------------------------ metrics


@query("epoch_metric_average", "SELECT event_type AS key, round(sum(value) / (SELECT count(DISTINCT user_id) FROM events), 6) AS average FROM events GROUP BY event_type")
def epoch_metric_average(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("step"), F.col("event_type").alias("key"), "value")
    return stats.metric_average(m).select("key", F.round("average", 6).alias("average"))


@query("linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_returnflag")
def linear_fit(spark, sf_dir):
    f = stats.linear_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("phase_summary", """SELECT event_type AS phase, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS longest, count(*) FILTER (value > 100) AS failures FROM events GROUP BY event_type""")
def phase_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("s"), (F.col("value") > 100).alias("bad"))
    p = stats.phase_summary(e, "phase", "s", "bad")
    return p.select("phase", "count", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "longest", "failures")


@query("set_hash", "SELECT user_id, sha256(array_to_string(list_sort(list(DISTINCT event_type)), ',')) AS members_sha256 FROM events GROUP BY user_id")
def set_hash(spark, sf_dir):
    return stats.set_hash(table(spark, sf_dir, "events"), ["user_id"], "event_type")
