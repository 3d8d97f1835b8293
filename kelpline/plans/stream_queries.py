"""Streams over events, replayed from files; poses, images and synthetic samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions import images, poses
from kelpline.operators import routing
from kelpline.plans.registry import micros, query, table
from kelpline.sources import traces
from kelpline.sources.shared import shared_dir
from kelpline.streaming import router, tables

_CONTROL = """w0 AS (SELECT user_id % 10 AS source, event_id AS window_id, epoch_us(ts) AS start, value, lead(epoch_us(ts)) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS following FROM events WHERE event_type = 'signup'),
w AS (SELECT source, window_id, start, CASE WHEN value <= 50 AND (following IS NULL OR start + 7200000000 < following) THEN start + 7200000000 ELSE following END AS stop FROM w0)"""


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return tables.replay(spark, path, spark.read.parquet(path).schema)


@query("stream_route", f"""WITH {_CONTROL} SELECT e.user_id % 10 AS source, e.event_id AS row_id, epoch_us(e.ts) AS ts, arg_max(w.window_id, {{'a': w.stop IS NOT NULL, 'b': w.start, 'c': w.window_id}}) AS window_id
FROM events e LEFT JOIN w ON w.source = e.user_id % 10 AND epoch_us(e.ts) >= w.start AND (w.stop IS NULL OR epoch_us(e.ts) < w.stop) GROUP BY ALL""")
def stream_route(spark, sf_dir):
    """Replays the events in three batches that overlap in time by less than the holdback."""
    hour = 3_600_000_000
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("source"), micros(F.col("ts")).alias("ts"), F.col("event_id").alias("item"), "event_type", "value")
    starts = e.where("event_type = 'signup'").withColumn("following", F.lead("ts").over(Window.partitionBy("source").orderBy("ts", "item")))
    stops = starts.where((F.col("value") <= 50) & (F.col("following").isNull() | (F.col("ts") + 2 * hour < F.col("following"))))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.col("ts") + F.pmod(F.xxhash64("item"), F.lit(hour)) - low) / max((high - low) // 3, 1)), F.lit(3)).cast("int")
    kind = lambda df, k: df.select("source", F.lit(k).alias("kind"), "ts", "item")
    moved = stops.withColumn("ts", F.col("ts") + 2 * hour)
    log = kind(e, "data").unionByName(kind(starts, "start")).unionByName(kind(moved, "stop")).withColumn("part", part)
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log.write.partitionBy("part").parquet(f"{root}-parts")
    log = spark.read.schema(log.schema).parquet(f"{root}-parts")
    schema = "source long, kind string, ts long, item long"
    for k in range(4):  # one file a batch, in this order
        log.where(F.col("part") == k).drop("part").repartition(1).write.mode("append").parquet(root)
    e.select("source").distinct().select("source", F.lit("flush").alias("kind"), F.lit(high).alias("ts"), F.lit(-1).cast("long").alias("item")).repartition(1).write.mode("append").parquet(root)
    return tables.drained(router.route_stream(tables.replay(spark, root, schema, 1), holdback_us=2 * hour, retention_us=8 * hour))


@query("stream_latest", "SELECT user_id AS recording_id, event_type AS sensor, arg_max(value, {'a': ts, 'b': event_id}) AS value, max(epoch_us(ts)) AS ts_us FROM events GROUP BY ALL")
def stream_latest(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("sensor"), micros(F.col("ts")).alias("ts_us"), "event_id", "value")
    return tables.drained(tables.latest_state(e, ["recording_id", "sensor"], ["ts_us", "event_id"], ["value", "ts_us"]), "complete")


@query("stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    doubled = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return tables.drained(tables.deduplicated(doubled, ["event_id"], "at", "40 days").select("event_id", "user_id", "value"))


@query("stream_expiry", "SELECT user_id AS source, event_id AS window_id, epoch_us(ts) AS start, epoch_us(ts) + 300000000 AS stop FROM events WHERE event_type = 'signup'")
def stream_expiry(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'signup'").select(F.col("user_id").alias("source"), F.col("event_id").alias("window_id"), micros(F.col("ts")).alias("start"))
    return tables.drained(routing.expired(e.withColumn("stop", F.lit(None).cast("long")), 300_000_000))


@query("stream_orphans", f"""WITH {_CONTROL} SELECT e.event_id AS row_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.source = e.user_id % 10 AND epoch_us(e.ts) >= w.start AND (w.stop IS NULL OR epoch_us(e.ts) < w.stop))""")
def stream_orphans(spark, sf_dir):
    return stream_route(spark, sf_dir).where("window_id is null").select("row_id")


@query("stream_upsert", "SELECT user_id, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    kept = tables.UpsertTable(spark, "user_id", ["ts_us", "event_id"])
    kept.follow(_events(spark, sf_dir).select("user_id", "event_id", micros(F.col("ts")).alias("ts_us"), "value")).awaitTermination()
    return kept.read().select("user_id", "value")


# ------------------------------------------------------------ poses, images


@query("pose_compose", """WITH p AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:3]] AS v, [x::DOUBLE FOR x IN embedding[8:10]] AS d, [x::DOUBLE FOR x IN embedding[4:7]] AS a, [x::DOUBLE FOR x IN embedding[11:14]] AS b FROM embeddings),
t AS (SELECT *, 2 * (a[2] * d[3] - a[3] * d[2]) AS tx, 2 * (a[3] * d[1] - a[1] * d[3]) AS ty, 2 * (a[1] * d[2] - a[2] * d[1]) AS tz FROM p)
SELECT vec_id, round(v[1] + d[1] + a[4] * tx + a[2] * tz - a[3] * ty, 9) AS x, round(v[2] + d[2] + a[4] * ty + a[3] * tx - a[1] * tz, 9) AS y, round(v[3] + d[3] + a[4] * tz + a[1] * ty - a[2] * tx, 9) AS z,
       round(a[4] * b[4] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], 9) AS qw FROM t""")
def pose_compose(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    pose = poses.compose(F.slice(e, 1, 7), F.slice(e, 8, 7))
    out = table(spark, sf_dir, "embeddings").select("vec_id", pose.alias("p"))
    return out.select("vec_id", *(F.round(F.get("p", i), 9).alias(c) for i, c in ((0, "x"), (1, "y"), (2, "z"), (6, "qw"))))


@query("pose_euler", """WITH p AS (SELECT vec_id, [radians(x::DOUBLE * 90) / 2 FOR x IN embedding[4:6]] AS h FROM embeddings)
SELECT vec_id, round(sin(h[1]) * cos(h[2]) * cos(h[3]) - cos(h[1]) * sin(h[2]) * sin(h[3]), 9) AS qx, round(cos(h[1]) * cos(h[2]) * cos(h[3]) + sin(h[1]) * sin(h[2]) * sin(h[3]), 9) AS qw FROM p""")
def pose_euler(spark, sf_dir):
    e = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 6), lambda x: x * 90)
    out = table(spark, sf_dir, "embeddings").select("vec_id", poses.from_euler(e, degrees=True).alias("p"))
    return out.select("vec_id", F.round(F.get("p", 3), 9).alias("qx"), F.round(F.get("p", 6), 9).alias("qw"))


def _pixels(spark, sf_dir):
    """Images of 16 pixels a row from the bytes of whole texts, padded to full rows."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(text)
    rows = F.greatest(F.ceil(n / 48), F.lit(1)).cast("int")
    padded = F.concat(text, F.unhex(F.repeat(F.lit("00"), rows * 48 - n)))
    return table(spark, sf_dir, "documents").select("doc_id", padded.alias("image"), rows.alias("rows"))


@query("resize_pad")
def resize_pad(spark, sf_dir):
    return _pixels(spark, sf_dir).select("doc_id", F.sha2(images.resize_pad(8, 8)("image", "rows", F.lit(16)), 256).alias("image_sha256"))


@query("gaussian_noise")
def gaussian_noise(spark, sf_dir):
    return _pixels(spark, sf_dir).select("doc_id", F.sha2(images.noisy(5.0, 3)("image", "doc_id"), 256).alias("image_sha256"))


@query("colour_jitter")
def colour_jitter(spark, sf_dir):
    return _pixels(spark, sf_dir).select("doc_id", F.sha2(images.jittered(0.2, 0.2, 3)("image", "doc_id"), 256).alias("image_sha256"))


@query("synthetic_source", """WITH s AS (SELECT r.id AS recording_id, v.sensor, ('0x' || substr(md5('5:' || r.id || ':' || v.sensor), 1, 8))::BIGINT % 1000000 / 1000000.0::DOUBLE AS value FROM range(200) r(id), (VALUES ('a'), ('b'), ('c')) v(sensor))
SELECT recording_id, recording_id % 3 AS robot_id, sensor, value FROM s""")
def synthetic_source(spark, sf_dir):
    return traces.synthetic(spark, 200, 3, ["a", "b", "c"], seed=5)


@query("json_traces", """SELECT user_id AS recording_id, event_type AS data_type, '[' || string_agg('{"ts_us":' || epoch_us(ts) || ',"event_id":' || event_id || '}', ',' ORDER BY epoch_us(ts), event_id) || ']' AS trace FROM events GROUP BY ALL""")
def json_traces(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("data_type"), micros(F.col("ts")).alias("ts_us"), "event_id")
    return traces.json_array_traces(s, ["recording_id", "data_type"], "ts_us")


@query("media_variant", """WITH f AS (SELECT p_brand AS recording, CASE WHEN p_size % 2 = 0 THEN 'RGB_IMAGES' ELSE 'DEPTH_IMAGES' END AS data_type, CASE WHEN p_partkey % 5 = 0 THEN 'lossless' ELSE 'lossy' END AS variant, p_name || p_partkey AS path FROM part)
SELECT recording, data_type, arg_min(path, CASE variant WHEN 'lossless' THEN '0' ELSE '1' END || path) AS path FROM f WHERE NOT (data_type = 'DEPTH_IMAGES' AND variant = 'lossy') GROUP BY ALL""")
def media_variant(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("recording"), F.when(F.col("p_size") % 2 == 0, "RGB_IMAGES").otherwise("DEPTH_IMAGES").alias("data_type"), F.when(F.col("p_partkey") % 5 == 0, "lossless").otherwise("lossy").alias("variant"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    return traces.best_variant(f, ["recording"])


@query("payload_slices", "SELECT doc_id, k AS frame_idx, substr(hex(encode(text)), k * 128 + 1, 128) AS payload FROM (SELECT doc_id, text, unnest(range((strlen(text) + 63) // 64)) AS k FROM documents WHERE text IS NOT NULL)")
def payload_slices(spark, sf_dir):
    """Every text's bytes in slices of 64."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("blob"))
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("blob") / 64).cast("int") - 1, F.lit(0)))
    index = d.where(F.octet_length("blob") > 0).select("doc_id", F.explode(at).alias("position"))
    index = index.select("doc_id", F.lit(None).cast("int").alias("frame_idx"), "position", (F.col("position") * 64).alias("offset"), F.lit(64).alias("length"))
    s = traces.payload_slices(index, d, "doc_id")
    return s.select("doc_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.hex("payload").alias("payload"))


