"""Checks and lookups of single values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import checks, scalars
from kelpline.operators import embodiment
from kelpline.plans.registry import query, table
from kelpline.sources import traces

_ID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"


@query("uuid_predicate", f"WITH h AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper({_ID}) WHEN o_orderkey % 3 = 1 THEN m ELSE {_ID} || 'x' END AS id, o_orderkey % 3 = 0 AS valid FROM h")
def uuid_predicate(spark, sf_dir):
    m, kind = F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 3
    parts = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    own = F.when(kind == 0, F.upper(parts)).when(kind == 1, m).otherwise(F.concat(parts, F.lit("x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", own.alias("id")).withColumn("valid", scalars.is_uuid(F.col("id")))


@query("joint_limits_by_name", """WITH l AS (SELECT event_type AS joint, min(value) + 5 AS low, max(value) - 5 AS high FROM events GROUP BY event_type)
SELECT e.event_id, CASE WHEN e.value < l.low - 1e-6 OR e.value > l.high + 1e-6 THEN 'position outside limits' END AS problem FROM events e JOIN l ON l.joint = e.event_type""")
def joint_limits_by_name(spark, sf_dir):
    """Limits come from a description by joint; a joint that it lacks is an error."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("joint"), "value")
    limits = e.groupBy("joint").agg((F.min("value") + 5).alias("low"), (F.max("value") - 5).alias("high"))
    return embodiment.with_limits(e, limits).select("event_id", checks.joint_position(F.col("value"), F.col("low"), F.col("high")).alias("problem"))


@query("clip_depth", "SELECT event_id, least(greatest(value / 10 - 2, 0), 10)::FLOAT AS depth FROM events")
def clip_depth(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.clip_depth(F.col("value") / 10 - 2).alias("depth"))


@query("episode_ids", "SELECT DISTINCT user_id AS episode_index FROM events ORDER BY user_id")
def episode_ids(spark, sf_dir):
    return traces.episode_ids(table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index")))


@query("payloads_by_frame", """WITH s AS (SELECT user_id AS recording_id, event_type AS sensor, event_id % 50 AS frame_idx, event_id FROM events), f AS (SELECT DISTINCT recording_id, sensor, frame_idx, md5(recording_id || sensor || frame_idx) AS payload FROM s WHERE frame_idx % 4 <> 0)
SELECT s.event_id, s.recording_id, s.sensor, s.frame_idx, f.payload FROM s LEFT JOIN f USING (recording_id, sensor, frame_idx)""")
def payloads_by_frame(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("sensor"), (F.col("event_id") % 50).alias("frame_idx"), "event_id")
    on = [F.col(c).cast("string") for c in ("recording_id", "sensor", "frame_idx")]
    frames = s.where("frame_idx % 4 <> 0").select("recording_id", "sensor", "frame_idx", F.md5(F.concat(*on)).alias("payload")).distinct()
    return traces.payloads_by_frame(s, frames).select("event_id", "recording_id", "sensor", "frame_idx", "payload")
