"""Routing, state, layouts, imports, checks and scalars over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import checks, scalars
from kelpline.operators import datasets, embodiment, episodes, importing, routing, state, stats
from kelpline.plans.registry import micros, query, table

# ------------------------------------------------------------------ routing

_WINDOWS = """data AS (SELECT user_id % 10 AS source, epoch_us(ts) AS ts, event_id AS row_id FROM events),
windows AS (SELECT user_id % 10 AS source, event_id AS window_id, epoch_us(ts) AS start,
  CASE WHEN value > 50 THEN NULL ELSE epoch_us(ts) + 7200000000 END AS stop FROM events WHERE event_type = 'signup')"""


def _routed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = micros(F.col("ts"))
    data = e.select((F.col("user_id") % 10).alias("source"), ts.alias("ts"), F.col("event_id").alias("row_id"))
    w = e.where(F.col("event_type") == "signup")
    return data, w.select((F.col("user_id") % 10).alias("source"), F.col("event_id").alias("window_id"), ts.alias("start"), F.when(F.col("value") <= 50, ts + 7_200_000_000).alias("stop"))


@query("interval_routing", f"""WITH {_WINDOWS}, closed AS (SELECT source, window_id, start, coalesce(stop, lead(start) OVER (PARTITION BY source ORDER BY start, window_id)) AS stop FROM windows),
met AS (SELECT d.row_id, arg_max(w.window_id, {{'a': w.stop IS NOT NULL, 'b': w.start, 'c': w.window_id}}) AS window_id FROM data d JOIN closed w ON d.source = w.source AND d.ts >= w.start AND (w.stop IS NULL OR d.ts < w.stop) GROUP BY d.row_id)
SELECT d.source, d.ts, d.row_id, m.window_id FROM data d LEFT JOIN met m USING (row_id)""")
def interval_routing(spark, sf_dir):
    data, windows = _routed(spark, sf_dir)
    return routing.route(data, routing.closed_by_next(windows), slot_us=6 * 3_600_000_000).select("source", "ts", "row_id", "window_id")


@query("orphan_drop", f"""WITH {_WINDOWS}, shut AS (SELECT source, window_id, start, coalesce(stop, start + 3600000000) AS stop FROM windows)
SELECT d.source, d.ts, d.row_id FROM data d WHERE NOT EXISTS (SELECT 1 FROM shut w WHERE w.source = d.source AND d.ts >= w.start AND d.ts < w.stop)""")
def orphan_drop(spark, sf_dir):
    data, windows = _routed(spark, sf_dir)
    return routing.orphans(data, windows.withColumn("stop", F.coalesce("stop", F.col("start") + 3_600_000_000)))


@query("retired_boundary", f"WITH {_WINDOWS} SELECT source, window_id, start, coalesce(stop, lead(start) OVER (PARTITION BY source ORDER BY start, window_id)) AS stop FROM windows")
def retired_boundary(spark, sf_dir):
    return routing.closed_by_next(_routed(spark, sf_dir)[1]).select("source", "window_id", "start", "stop")


@query("window_expiry", f"WITH {_WINDOWS} SELECT source, window_id, start, least(coalesce(stop, start + 3600000000), start + 3600000000) AS stop FROM windows")
def window_expiry(spark, sf_dir):
    return routing.expired(_routed(spark, sf_dir)[1], 3_600_000_000).select("source", "window_id", "start", "stop")


@query("idle_close", """WITH d AS (SELECT user_id AS source, epoch_us(ts) AS ts, event_id AS row_id FROM events),
m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts, row_id) > 43200000000 OR lag(ts) OVER (PARTITION BY source ORDER BY ts, row_id) IS NULL THEN 1 ELSE 0 END AS s FROM d),
n AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS nth FROM m)
SELECT source, nth::BIGINT AS nth, min(ts) AS start, max(ts) + 43200000000 AS stop, count(*) AS rows FROM n GROUP BY source, nth""")
def idle_close(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), micros(F.col("ts")).alias("ts"), F.col("event_id").alias("row_id"))
    return routing.idle_closed(d, "source", 43_200_000_000)


@query("cancel_purge", """WITH d AS (SELECT user_id AS source, epoch_us(ts) AS ts, event_id AS row_id, event_type, value FROM events), c AS (SELECT source, max(ts) AS cancel_ts FROM d WHERE event_type = 'error' AND value > 100 GROUP BY source)
SELECT d.source, d.ts, d.row_id FROM d LEFT JOIN c USING (source) WHERE cancel_ts IS NULL OR d.ts > cancel_ts""")
def cancel_purge(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), micros(F.col("ts")).alias("ts"), F.col("event_id").alias("row_id"), "event_type", "value")
    return routing.cancelled(d, d.where("event_type = 'error' and value > 100")).select("source", "ts", "row_id")


@query("budgeted_admission", """WITH u AS (SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used FROM lineitem)
SELECT * FROM u WHERE used <= 500""")
def budgeted_admission(spark, sf_dir):
    a = routing.admitted(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", 500)
    return a.select("l_suppkey", "l_orderkey", "l_linenumber", "used")


@query("chunk_straddle_cut", """WITH f AS (SELECT user_id AS chunk, event_id, epoch_us(ts) AS frame_us, min(epoch_us(ts)) OVER (PARTITION BY user_id) + 864000000000 AS bound FROM events),
p AS (SELECT *, bool_or(frame_us >= bound) OVER (PARTITION BY chunk ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS passed FROM f)
SELECT chunk, event_id, frame_us FROM p WHERE NOT passed""")
def chunk_straddle_cut(spark, sf_dir):
    from pyspark.sql.window import Window

    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk"), "event_id", micros(F.col("ts")).alias("frame_us"))
    f = f.withColumn("bound", F.min("frame_us").over(Window.partitionBy("chunk")) + 864_000_000_000)
    return routing.straddle_cut(f, "chunk", "event_id", "frame_us", "bound").select("chunk", "event_id", "frame_us")


# -------------------------------------------------------------------- state


@query("reclaimable", """SELECT o_orderkey, o_orderstatus FROM (SELECT *, o_orderkey % 7 + 1 AS expected FROM orders) o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 5)
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity < 5)
  AND (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) = expected""")
def reclaimable(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), "o_orderstatus", (F.col("o_orderkey") % 7 + 1).alias("expected"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") >= 5).alias("done"))
    return state.reclaimable(o, t, "o_orderkey", "expected", "done").select("o_orderkey", "o_orderstatus")


_REC = """r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) END AS stopped_at, CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS cancelled_at,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS recording_id, o_orderkey % 2 = 0 AS progress_reported, o_orderkey % 7 AS expected_traces, o_orderkey % 3 AS expected_traces_reported FROM orders)"""


@query("pending_progress", f"""WITH {_REC} SELECT o_orderkey FROM r WHERE stopped_at IS NOT NULL AND cancelled_at IS NULL AND recording_id IS NOT NULL
AND (NOT progress_reported OR expected_traces_reported IS NULL OR expected_traces_reported <> expected_traces)""")
def pending_progress(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(
        k, F.when(F.col("o_orderstatus") != "O", micros(F.col("o_orderdate"))).alias("stopped_at"), F.when(k % 11 == 0, 1).alias("cancelled_at"), F.when(k % 5 != 0, F.col("o_custkey")).alias("recording_id"),
        (k % 2 == 0).alias("progress_reported"), (k % 7).alias("expected_traces"), (k % 3).alias("expected_traces_reported"),
    )
    return state.pending_progress(r).select("o_orderkey")


@query("claim_oldest_n", "SELECT o_orderkey, epoch_us(o_orderdate) AS updated_us FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def claim_oldest_n(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", micros(F.col("o_orderdate")).alias("updated_us"))
    return state.claim_oldest(o, "updated_us", "o_orderkey", 25, now=1 << 60, least_age=60_000_000)


@query("claim_retries", "SELECT o_orderkey FROM orders WHERE substr(o_orderpriority, 1, 1)::INT < 3 AND epoch_us(o_orderdate) < 800000000000000 ORDER BY o_orderdate, o_orderkey LIMIT 40")
def claim_retries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("attempts"), micros(F.col("o_orderdate")).alias("updated_us"))
    return state.claim_retries(o, "attempts", 3, "updated_us", 800_000_000_000_000, "o_orderkey", 40).select("o_orderkey")


@query("ordered_traces", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS place FROM lineitem")
def ordered_traces(spark, sf_dir):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    placed = episodes.frame_index(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, "place")
    return placed.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "place")


@query("latest_match", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' ORDER BY o_orderkey DESC LIMIT 1")
def latest_match(spark, sf_dir):
    return state.latest_match(table(spark, sf_dir, "orders"), "o_orderpriority = '1-URGENT' and o_orderstatus <> 'P'", "o_orderkey").select("o_orderkey", "o_custkey")


@query("ready_count", "SELECT count(*) AS ready FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10")
def ready_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_quantity > 10").agg(F.count(F.lit(1)).alias("ready"))


@query("trace_count_equality", "SELECT o_orderkey, count(l_orderkey) AS n_traces, count(l_orderkey) = o_orderkey % 7 AS as_expected FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def trace_count_equality(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").withColumn("n_traces", F.coalesce("n", F.lit(0)))
    return o.select("o_orderkey", "n_traces", (F.col("n_traces") == F.col("o_orderkey") % 7).alias("as_expected"))


_TRACES = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'registering' ELSE 'registered' END AS registration_status,
  CASE WHEN l_quantity > 25 THEN 'written' ELSE 'writing' END AS write_status, CASE WHEN l_partkey % 5 = 0 THEN 'uploading' WHEN l_partkey % 5 = 1 THEN 'uploaded' END AS upload_status FROM lineitem)"""


def _traces(spark, sf_dir):
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", p, F.when(p % 3 == 0, "registering").otherwise("registered").alias("registration_status"),
        F.when(F.col("l_quantity") > 25, "written").otherwise("writing").alias("write_status"), F.when(p % 5 == 0, "uploading").when(p % 5 == 1, "uploaded").alias("upload_status"),
    )


@query("promote_traces", f"WITH {_TRACES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN registration_status = 'registered' AND write_status = 'written' AND upload_status IS NULL THEN 'pending' ELSE upload_status END AS upload_status FROM t")
def promote_traces(spark, sf_dir):
    return state.promoted(_traces(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "upload_status")


@query("crash_reset", f"WITH {_TRACES} SELECT l_orderkey, l_linenumber, l_partkey, CASE registration_status WHEN 'registering' THEN 'pending' ELSE registration_status END AS registration_status, CASE upload_status WHEN 'uploading' THEN 'pending' ELSE upload_status END AS upload_status FROM t")
def crash_reset(spark, sf_dir):
    return state.reset_after_crash(_traces(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "registration_status", "upload_status")


@query("cascade_delete", "SELECT l_orderkey, count(*) AS n_traces FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def cascade_delete(spark, sf_dir):
    o, t = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), table(spark, sf_dir, "lineitem")
    return state.cascade_delete(o, t, "l_orderkey", F.col("o_orderstatus") == "F")[1].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_traces"))


@query("insert_once", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def insert_once(spark, sf_dir):
    old = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).distinct()
    return state.inserted_once(old, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


@query("compare_and_set", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'claimed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def compare_and_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return state.compare_and_set(o, "o_orderstatus", F.lit("O"), F.lit("claimed"))


# ----------------------------------------------------------------- datasets


@query("merge_datasets", "SELECT DISTINCT o_orderkey AS recording_id FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'F'")
def merge_datasets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recording_id"), "o_totalprice", "o_orderstatus")
    return datasets.merged(o.where("o_totalprice > 150000"), o.where("o_orderstatus = 'F'")).select("recording_id")


@query("distinct_recordings", "SELECT count(DISTINCT o_orderkey) AS recordings FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def distinct_recordings(spark, sf_dir):
    return merge_datasets(spark, sf_dir).agg(F.count(F.lit(1)).alias("recordings"))


@query("clone_dataset", "SELECT o_orderkey AS recording_id, 'copy' AS dataset_id FROM orders WHERE o_orderstatus = 'P'")
def clone_dataset(spark, sf_dir):
    return datasets.cloned(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("recording_id")), "copy")


@query("recording_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 30")
def recording_page(spark, sf_dir):
    return datasets.page(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("recording_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def recording_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return datasets.lookup(c, "c_custkey", c.agg(F.min("c_custkey")).first()[0])


# --------------------------------------------------------------- embodiment

_NAMES = "SELECT c_nationkey AS robot, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal < 1000)) AS a, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 8000)) AS b FROM customer GROUP BY c_nationkey"


def _names(spark, sf_dir):
    pick = lambda own: F.array_sort(F.collect_set(F.when(own, F.col("c_mktsegment"))))
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("robot")).agg(pick(balance < 1000).alias("a"), pick(balance > 8000).alias("b"))


@query("ordered_union", f"WITH n AS ({_NAMES}) SELECT robot, array_to_string(list_concat(coalesce(a, []), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS names FROM n")
def ordered_union(spark, sf_dir):
    return _names(spark, sf_dir).select("robot", F.array_join(embodiment.ordered_union(F.col("a"), F.col("b")), ",").alias("names"))


@query("trained_intersection", f"""WITH n AS (SELECT robot, coalesce(a, []) AS a, coalesce(b, []) AS b FROM ({_NAMES})) SELECT robot, array_to_string(CASE WHEN len(list_intersect(a, b)) > 0 THEN list_sort(list_intersect(a, b)) ELSE list_sort(list_distinct(list_concat(a, b))) END, ',') AS names FROM n""")
def trained_intersection(spark, sf_dir):
    return _names(spark, sf_dir).select("robot", F.array_join(embodiment.intersection_or_union(F.col("a"), F.col("b")), ",").alias("names"))


@query("missing_names", "WITH every AS (SELECT DISTINCT c_mktsegment AS name FROM customer) SELECT DISTINCT c.c_nationkey AS robot, e.name FROM customer c, every e EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8000")
def missing_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("robot"), F.col("c_mktsegment").alias("name"), "c_acctbal")
    every = c.agg(F.collect_set("name").alias("names"))  # the segments: a handful
    wanted = c.select("robot").distinct().join(F.broadcast(every)).select("robot", F.explode("names").alias("name"))
    return wanted.exceptAll(c.where("c_acctbal > 8000").select("robot", "name").distinct())


def _days(spark, sf_dir):
    """Events with the day of their user as the recording: most days lack some sensor."""
    day = F.floor(micros(F.col("ts")) / 86_400_000_000)
    return table(spark, sf_dir, "events").withColumn("recording_day", F.concat_ws(":", "user_id", day))


@query("required_types", """WITH u AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS recording_day, list(DISTINCT event_type) AS seen FROM events GROUP BY 1)
SELECT recording_day, array_to_string(list_filter(['click', 'signup', 'view'], lambda x: NOT list_contains(seen, x)), ',') AS missing FROM u WHERE len(list_filter(['click', 'signup', 'view'], lambda x: NOT list_contains(seen, x))) > 0""")
def required_types(spark, sf_dir):
    lack = embodiment.lacking(_days(spark, sf_dir), "recording_day", "event_type", ["click", "signup", "view"])
    return lack.select("recording_day", F.array_join("missing", ",").alias("missing"))


@query("missing_type_report", """WITH u AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS recording_day, list(DISTINCT event_type) AS seen FROM events GROUP BY 1), m AS (SELECT recording_day, unnest(list_filter(['click', 'signup', 'view'], lambda x: NOT list_contains(seen, x))) AS missing FROM u)
SELECT missing, array_to_string(list(recording_day ORDER BY recording_day), ',') AS groups FROM m GROUP BY missing""")
def missing_type_report(spark, sf_dir):
    lack = embodiment.groups_by_lack(_days(spark, sf_dir), "recording_day", "event_type", ["click", "signup", "view"])
    return lack.select("missing", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


_LAYOUT = {"view": 0, "click": 1, "purchase": 3}


def _layout(spark):
    return spark.createDataFrame(list(_LAYOUT.items()), "sensor string, slot int")


@query("project_strict", "SELECT user_id AS recording_id, event_type AS sensor, max(value) AS value, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 3 END AS slot FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL")
def project_strict(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("recording_id"), F.col("event_type").alias("sensor")).agg(F.max("value").alias("value"))
    return embodiment.project_strict(e, _layout(spark), ["recording_id"]).select("recording_id", "sensor", "value", "slot")


@query("project_lenient", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def project_lenient(spark, sf_dir):
    return embodiment.project_lenient(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("sensor")), _layout(spark), "sensor").withColumnRenamed("sensor", "event_type")


@query("missing_sensors", "WITH d AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS recording_day, event_type FROM events) SELECT DISTINCT d.recording_day, s.sensor FROM d, (VALUES ('view'), ('click'), ('purchase')) s(sensor) EXCEPT SELECT recording_day, event_type FROM d")
def missing_sensors(spark, sf_dir):
    return embodiment.missing_sensors(_days(spark, sf_dir).withColumnRenamed("event_type", "sensor"), _layout(spark), "recording_day")


@query("slot_width", "SELECT p_brand AS robot, greatest(max(p_size), 0) + 1 AS width FROM part GROUP BY p_brand")
def slot_width(spark, sf_dir):
    return embodiment.slot_width(table(spark, sf_dir, "part").select(F.col("p_brand").alias("robot"), F.col("p_size").alias("slot")), ["robot"])


@query("slot_order", "WITH s AS (SELECT p_brand AS robot, p_size AS slot, max(p_retailprice) AS value FROM part GROUP BY ALL) SELECT robot, array_to_string(list(printf('%.2f', value) ORDER BY slot), ';') AS by_slot FROM s GROUP BY robot")
def slot_order(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("robot"), F.col("p_size").alias("slot")).agg(F.max("p_retailprice").alias("value"))
    own = embodiment.slot_ordered(s, ["robot"], "slot", "value", "by_slot")
    return own.select("robot", F.array_join(F.transform("by_slot", lambda v: F.format_string("%.2f", v)), ";").alias("by_slot"))


@query("names_per_slot", "SELECT p_size AS slot, array_to_string(list_sort(list(DISTINCT p_brand)), ' / ') AS names FROM part GROUP BY p_size")
def names_per_slot(spark, sf_dir):
    return embodiment.names_per_slot(table(spark, sf_dir, "part").select(F.col("p_size").alias("slot"), "p_brand"), ["slot"], "p_brand")


def _slot_sql(k: int) -> str:
    return f"printf('%.2f', coalesce(max(value) FILTER (slot = {k}), 0))"


def _mask_sql(k: int) -> str:
    return f"(count(*) FILTER (slot = {k}) > 0)::INT"


@query("mask_and_pad", f"""WITH l AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS recording_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 END AS slot, max(value) AS value
  FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)
SELECT recording_id, {" || ';' || ".join(map(_slot_sql, range(5)))} AS "values", {" || ';' || ".join(map(_mask_sql, range(5)))} AS mask FROM l GROUP BY recording_id""")
def mask_and_pad(spark, sf_dir):
    e = _days(spark, sf_dir).select(F.col("recording_day").alias("recording_id"), F.col("event_type").alias("sensor"), "value").join(F.broadcast(_layout(spark)), "sensor")
    own = embodiment.masked(e.groupBy("recording_id", "slot").agg(F.max("value").alias("value")), 5, ["recording_id"])
    text = lambda c, f: F.array_join(F.transform(c, lambda v: F.format_string(f, v)), ";")
    return own.select("recording_id", text("values", "%.2f").alias("values"), text("mask", "%.0f").alias("mask"))


@query("collate_batch", "SELECT event_id // 32 AS batch, count(*)::INT AS batch_size, array_to_string(list(printf('%.2f', value) ORDER BY event_id), ';') AS value FROM events GROUP BY 1")
def collate_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 32).alias("batch"), "event_id", "value")
    c = embodiment.collated(e, "batch", "event_id", ["value"])
    return c.select("batch", "batch_size", F.array_join(F.transform("value", lambda v: F.format_string("%.2f", v)), ";").alias("value"))


@query("relative_action", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount + o_totalprice AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def relative_action(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("delta"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("position"))
    return embodiment.relative_to_same_step(t, p, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "target")


@query("remote_nodes", "SELECT s_nationkey AS robot, bool_and(s_acctbal > 0) AS all_connected FROM supplier GROUP BY s_nationkey")
def remote_nodes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("robot"), F.col("s_suppkey").alias("node"), (F.col("s_acctbal") > 0).alias("connected"))
    return embodiment.fully_connected(s.select("robot", "node"), s.select("node", "connected"), "robot", "node")


@query("name_resolution", "SELECT c_name AS name, coalesce(min(c_custkey) FILTER (c_acctbal > 5000), min(c_custkey) FILTER (c_acctbal > 0)) AS id FROM customer GROUP BY c_name")
def name_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), "c_acctbal")
    return embodiment.resolve_names(c.select("name").distinct(), c.where("c_acctbal > 5000"), c.where("c_acctbal > 0"))


# ---------------------------------------------------------------- importing

_MAPPING = [{"source_name": "/view.k", "name": "a"}, {"source_name": "k", "source": "click", "name": "b"}, {"source_name": "k", "source": "click", "name": "c"}]


@query("import_fanout", "SELECT e.event_id, m.name FROM events e JOIN (VALUES ('view', 'a'), ('click', 'b'), ('click', 'c')) m(topic, name) ON e.event_type = m.topic")
def import_fanout(spark, sf_dir):
    rows = [(m["topic"].lstrip("/"), m["name"]) for m in importing.mappings(_MAPPING)]
    mapping = spark.createDataFrame(rows, "topic string, name string")
    return importing.fan_out(table(spark, sf_dir, "events").withColumnRenamed("event_type", "topic"), F.broadcast(mapping)).select("event_id", "name")


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", importing.json_path(F.col("props"), ["k"]).cast("long").alias("k"))


@query("array_slice", "SELECT vec_id, array_to_string(list_transform(embedding[6:10], lambda x: printf('%.4f', x::DOUBLE)), ';') AS part, embedding[4]::DOUBLE AS element FROM embeddings")
def array_slice(spark, sf_dir):
    part = importing.sliced(F.col("embedding").cast("array<double>"), 5, 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(part, lambda x: F.format_string("%.4f", x)), ";").alias("part"), F.get("embedding", 3).cast("double").alias("element"))


@query("split_pose", "SELECT vec_id, array_to_string(list_transform(list_concat(embedding[1:3], embedding[11:14]), lambda x: printf('%.4f', x::DOUBLE)), ';') AS pose FROM embeddings")
def split_pose(spark, sf_dir):
    pose = importing.split_pose(F.col("embedding").cast("array<double>"), (0, 3), (10, 14))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(pose, lambda x: F.format_string("%.4f", x)), ";").alias("pose"))


@query("topic_estimate", "SELECT nullif(count(*) FILTER (event_type IN ('view', 'click')), 0) AS expected FROM events")
def topic_estimate(spark, sf_dir):
    channels = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("messages"))
    return importing.topic_estimate(channels, ["view", "click"])


@query("resume_antijoin", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return importing.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("skip_on_error", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 2)")
def skip_on_error(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")  # noqa: E741
    return importing.skip_on_error(l, "l_orderkey", F.col("l_quantity") < 2, "episode").drop("l_quantity")


@query("timestamp_resolution", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey > 0 THEN o_orderkey * 1000 ELSE (o_custkey + 1) * 1000 END / 1e9 AS seconds FROM orders")
def timestamp_resolution(spark, sf_dir):
    log = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 1000).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", importing.resolved_time(log, (F.col("o_custkey") + 1) * 1000).alias("seconds"))


@query("latest_version", "SELECT p_brand, max(p_type) AS version FROM part GROUP BY p_brand")
def latest_version(spark, sf_dir):
    return importing.latest_version(table(spark, sf_dir, "part"), "p_brand", "p_type")


# ------------------------------------------------------------------- checks


@query("validate_joint", "SELECT event_id, CASE WHEN value < 10 - 1e-6 OR value > 100 + 1e-6 THEN 'position outside limits' END AS problem FROM events")
def validate_joint(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", checks.joint_position(F.col("value"), F.lit(10.0), F.lit(100.0)).alias("problem"))


@query("validate_velocity", "SELECT event_id, CASE WHEN abs(value - 50) > 40 THEN 'velocity over limit' END AS problem FROM events")
def validate_velocity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", checks.joint_magnitude(F.col("value") - 50, F.lit(40.0)).alias("problem"))


@query("validate_gripper", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT (l_discount * 12 BETWEEN 0 AND 1) THEN 'gripper outside 0 to 1' END AS problem FROM lineitem")
def validate_gripper(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", checks.gripper(F.col("l_discount") * 12).alias("problem"))


@query("validate_quaternion", """WITH q AS (SELECT vec_id, embedding[4:7] AS q FROM embeddings), n AS (SELECT vec_id, [x::DOUBLE / CASE WHEN vec_id % 2 = 0 THEN sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN q])) ELSE 1 END FOR x IN q] AS q FROM q)
SELECT vec_id, CASE WHEN NOT (abs(sqrt(list_sum([y * y FOR y IN q])) - 1) <= 1e-4 + 1e-5) THEN 'quaternion not of unit length' END AS problem FROM n""")
def validate_quaternion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 7).alias("pose"))
    norm = F.sqrt(F.aggregate(F.slice("pose", 4, 4), F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.when(F.col("vec_id") % 2 == 0, F.transform("pose", lambda x: x / norm)).otherwise(F.col("pose"))
    return e.select("vec_id", checks.unit_quaternion(scaled).alias("problem"))


@query("validate_shape", "SELECT p_partkey, CASE WHEN p_size % 4 <> 3 THEN '3 channels needed' WHEN p_size * (p_size % 4) * 8 <> p_size * 24 THEN 'bytes do not fill the shape' END AS problem FROM part")
def validate_shape(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", checks.shape(s % 4, s, F.lit(8), s * 24).alias("problem"))


@query("validate_language", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty text' END AS problem FROM documents")
def validate_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checks.language(F.col("text")).alias("problem"))


# ------------------------------------------------------------------ scalars


@query("depth_codec", """WITH l AS (SELECT event_id, floor(least(greatest(value / 20, 0), 10.0::DOUBLE) / 10.0::DOUBLE * 16777215)::BIGINT AS level FROM events)
SELECT event_id, level >> 16 AS r, (level >> 8) & 255 AS g, level & 255 AS b, round(((level >> 16) * 65536 + ((level >> 8) & 255) * 256 + (level & 255)) / 16777215.0::DOUBLE * 10, 6) AS metres FROM l""")
def depth_codec(spark, sf_dir):
    level = scalars.depth_to_level(F.col("value") / 20)
    r, g, b = scalars.level_to_rgb(F.col("level"))
    e = table(spark, sf_dir, "events").select("event_id", level.alias("level")).select("event_id", r.alias("r"), g.alias("g"), b.alias("b"))
    return e.withColumn("metres", F.round(scalars.rgb_to_depth(F.col("r"), F.col("g"), F.col("b")), 6))


@query("size_parse", """WITH t AS (SELECT p_partkey, p_size || CASE p_partkey % 5 WHEN 0 THEN 'kb' WHEN 1 THEN ' MB' WHEN 2 THEN '.5gb' WHEN 3 THEN '' ELSE 'xb' END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::BIGINT * 1024 WHEN 1 THEN p_size::BIGINT * 1048576 WHEN 2 THEN ((p_size + 0.5::DOUBLE) * 1073741824)::BIGINT WHEN 3 THEN p_size::BIGINT END AS bytes FROM part""")
def size_parse(spark, sf_dir):
    k = F.col("p_partkey") % 5
    unit = F.when(k == 0, "kb").when(k == 1, " MB").when(k == 2, ".5gb").when(k == 3, "").otherwise("xb")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.size_in_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("next_free_name", """WITH taken AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_brand || '_' || p_size FROM part WHERE p_size < 40), u AS (SELECT DISTINCT p_brand AS base, p_size AS n FROM part WHERE p_size BETWEEN 1 AND 39),
c AS (SELECT b.base, g.n FROM (SELECT DISTINCT p_brand AS base FROM part) b, range(1, 42) g(n))
SELECT base AS name, base || '_' || min(n) AS free_name FROM c ANTI JOIN u ON c.base = u.base AND c.n = u.n GROUP BY base""")
def next_free_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    taken = p.select(F.col("p_brand").alias("name")).union(p.where("p_size < 40").select(F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string"))))
    return scalars.next_free_name(taken, p.select(F.col("p_brand").alias("name")).distinct())


@query("spec_hash", """SELECT o_orderkey, substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 16) AS spec FROM orders""")
def spec_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.spec_hash("o_orderstatus", "o_orderkey", "o_custkey").alias("spec"))


@query("label_split", "SELECT event_id, event_type AS data_type, user_id || ':' || event_id AS name FROM events")
def label_split(spark, sf_dir):
    label = F.concat_ws(":", "event_type", "user_id", "event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.label_type(label).alias("data_type"), scalars.label_name(label).alias("name"))


@query("publish_offset", "SELECT event_id, greatest(0, floor((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) * 1000 / 1000000.0))::BIGINT AS offset_ms FROM events")
def publish_offset(spark, sf_dir):
    from pyspark.sql.window import Window

    us = micros(F.col("ts"))
    e = table(spark, sf_dir, "events").select("event_id", us.alias("us"), F.first(us).over(Window.partitionBy("user_id").orderBy("event_id")).alias("first"))
    return e.select("event_id", scalars.publish_offset_ms(F.col("us") * 1000, F.col("first") * 1000).alias("offset_ms"))


@query("unit_transforms", "SELECT event_id, round(-radians(value) + 0.5, 9) AS angle, round(value / 1000, 9) AS metres, round(1 - (value - 0) / 500.0, 9) AS gripper FROM events")
def unit_transforms(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.transformed(v, degrees=True, inverted=True, offset=0.5), 9).alias("angle"), F.round(scalars.transformed(v, millimetres=True), 9).alias("metres"), F.round(scalars.normalised_gripper(v, 0.0, 500.0, inverted=True), 9).alias("gripper"))


@query("text_uris", "SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS uri FROM pages")
def text_uris(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.translate(scalars.data_uri(F.encode("html", "UTF-8"), "text/html"), "\r\n", "").alias("uri"))


@query("byte_totals", "SELECT source, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def byte_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("loss_reduction", "SELECT o_orderkey % 16 AS step, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def loss_reduction(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 16).alias("step")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("log_query", "SELECT event_id, event_type AS severity FROM events WHERE event_type IN ('error', 'signup') ORDER BY event_id DESC LIMIT 100")
def log_query(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).orderBy(F.desc("event_id")).limit(100).select("event_id", F.col("event_type").alias("severity"))
