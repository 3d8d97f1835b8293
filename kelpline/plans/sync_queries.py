"""Synchronisation queries: events as streams on a six-hour clock."""

from __future__ import annotations

from kelpline.operators import sync
from kelpline.plans.registry import SAMPLES_SQL, query, samples

PERIOD = 6 * sync.HOUR
_STREAMS = f"{SAMPLES_SQL}, streams AS (SELECT recording_id, sensor, min(ts_us) AS f, max(ts_us) AS l FROM samples GROUP BY ALL)"


def _grid(start: str, end: str, period: int = PERIOD) -> str:
    return f"""{_STREAMS},
clock AS (SELECT recording_id, {start} AS start_us, {end} AS end_us FROM streams GROUP BY recording_id),
grid AS (SELECT recording_id, unnest(range(0, (end_us - start_us) // {period} + 1)) AS step, start_us FROM clock WHERE start_us <= end_us),
cells AS (SELECT g.recording_id, s.sensor, g.step, g.start_us + g.step * {period} AS grid_us FROM grid g JOIN streams s USING (recording_id)),
synced AS (SELECT c.recording_id, c.sensor, c.step, c.grid_us, s.ts_us AS src_us, s.value
           FROM cells c ASOF LEFT JOIN samples s ON c.recording_id = s.recording_id AND c.sensor = s.sensor AND c.grid_us >= s.ts_us)"""


_OPEN, _TRIMMED = _grid("min(f)", "max(l)"), _grid("max(f)", "min(l)")


def _synced(spark, sf_dir, trim=False, direction="backward"):
    s = samples(spark, sf_dir)
    return sync.periodic(s, sync.bounds(s, trim), PERIOD, direction)


@query("sync_asof_backward", f"WITH {_OPEN} SELECT * FROM synced")
def sync_asof_backward(spark, sf_dir):
    return _synced(spark, sf_dir)


@query(
    "sync_asof_nearest",
    f"""WITH {_OPEN}, ahead AS (
  SELECT c.recording_id, c.sensor, c.step, s.ts_us AS next_us, s.value AS next_value
  FROM cells c ASOF LEFT JOIN samples s ON c.recording_id = s.recording_id AND c.sensor = s.sensor AND c.grid_us <= s.ts_us)
SELECT b.recording_id, b.sensor, b.step, b.grid_us,
       CASE WHEN next_us IS NOT NULL AND (src_us IS NULL OR next_us - grid_us < grid_us - src_us) THEN next_us ELSE src_us END AS src_us,
       CASE WHEN next_us IS NOT NULL AND (src_us IS NULL OR next_us - grid_us < grid_us - src_us) THEN next_value ELSE value END AS value
FROM synced b JOIN ahead a ON a.recording_id = b.recording_id AND a.sensor = b.sensor AND a.step = b.step""",
)
def sync_asof_nearest(spark, sf_dir):
    return _synced(spark, sf_dir, direction="nearest")


@query(
    "sync_max_delay",
    f"""WITH {_OPEN} SELECT recording_id, sensor, step, grid_us, CASE WHEN grid_us - src_us <= {24 * sync.HOUR} THEN src_us END AS src_us,
       CASE WHEN grid_us - src_us <= {24 * sync.HOUR} THEN value END AS value FROM synced""",
)
def sync_max_delay(spark, sf_dir):
    return sync.within_delay(_synced(spark, sf_dir), 24 * sync.HOUR)


@query(
    "sync_no_duplicates",
    f"""WITH {_OPEN} SELECT recording_id, sensor, step, grid_us, src_us, value FROM synced WHERE src_us IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY recording_id, sensor, src_us ORDER BY step) = 1""",
)
def sync_no_duplicates(spark, sf_dir):
    return sync.without_duplicates(_synced(spark, sf_dir))


@query("sync_trim_start_end", f"WITH {_TRIMMED} SELECT * FROM synced")
def sync_trim_start_end(spark, sf_dir):
    return _synced(spark, sf_dir, trim=True)


@query(
    "sync_aperiodic",
    f"""WITH {_STREAMS}, grid AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ts_us) - 1 AS step, ts_us AS grid_us
  FROM (SELECT DISTINCT recording_id, ts_us FROM samples)),
cells AS (SELECT g.recording_id, s.sensor, g.step, g.grid_us FROM grid g JOIN streams s USING (recording_id))
SELECT c.recording_id, c.sensor, c.step, c.grid_us, s.ts_us AS src_us, s.value
FROM cells c ASOF LEFT JOIN samples s ON c.recording_id = s.recording_id AND c.sensor = s.sensor AND c.grid_us >= s.ts_us""",
)
def sync_aperiodic(spark, sf_dir):
    s = samples(spark, sf_dir)
    return sync.asof(s, sync.for_each_sensor(sync.aperiodic_grid(s), s))


@query(
    "sync_failure_report",
    f"""WITH {_TRIMMED}, uses AS (SELECT *, count(*) OVER (PARTITION BY recording_id, sensor, src_us) AS n FROM synced)
SELECT recording_id, CASE WHEN bool_or(coalesce(grid_us - src_us > {120 * sync.HOUR}, true)) THEN 'within max delta'
       WHEN bool_or(n > 1) THEN 'too sparse' END AS failure FROM uses GROUP BY recording_id""",
)
def sync_failure_report(spark, sf_dir):
    return sync.failures(_synced(spark, sf_dir, trim=True), 120 * sync.HOUR, allow_duplicates=False)


@query(
    "trim_no_movement",
    f"""WITH {SAMPLES_SQL}, moved AS (SELECT *, abs(value - first_value(value) OVER (PARTITION BY recording_id, sensor ORDER BY ts_us)) > 5 AS m FROM samples),
since AS (SELECT recording_id, min(ts_us) FILTER (m) AS since FROM moved GROUP BY recording_id)
SELECT recording_id, sensor, ts_us, value FROM samples JOIN since USING (recording_id) WHERE ts_us >= since""",
)
def trim_no_movement(spark, sf_dir):
    return sync.moved_from_start(samples(spark, sf_dir), 5.0)


@query(
    "sync_wide",
    f"""WITH {_OPEN} SELECT recording_id, step, grid_us, max(value) FILTER (sensor = 'view') AS view, max(value) FILTER (sensor = 'click') AS click,
       max(value) FILTER (sensor = 'purchase') AS purchase FROM synced GROUP BY recording_id, step, grid_us""",
)
def sync_wide(spark, sf_dir):
    return sync.wide(_synced(spark, sf_dir), ["view", "click", "purchase"])
