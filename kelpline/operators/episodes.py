"""Windows and sequences within recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ABSOLUTE, RELATIVE = 1e-6, 1e-5  # of the comparison of a target with the next position


def _line(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def frame_index(rows: DataFrame, by: list[str], order: list[str], name: str = "frame_idx") -> DataFrame:
    """0-based position in capture order."""
    return rows.withColumn(name, (F.row_number().over(_line(by, order)) - 1).cast("long"))


def action_chunks(rows: DataFrame, by: list[str], order: list[str], value: str, horizon: int, target: bool, pad: bool = True, name: str = "chunk") -> DataFrame:
    """The next ``horizon`` values of every row: from its own on for targets, else from the next.

    ``pad`` repeats the last one at the end of a recording. A row that has none
    (the last of a recording, unless it is a target's) gets an empty array.
    Nulls are values.
    """
    first = 0 if target else 1
    window = _line(by, order).rowsBetween(first, first + horizon - 1)
    own = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(window), lambda s: s["v"])
    rows = rows.withColumn(name, own)
    if not pad:
        return rows
    missing = F.when(F.size(name) > 0, F.lit(horizon) - F.size(name)).otherwise(F.lit(0))
    return rows.withColumn(name, F.concat(name, F.array_repeat(F.try_element_at(name, F.lit(-1)), missing)))


def drop_last_frame(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("later", F.lead(F.lit(1)).over(_line(by, order))).where("later is not null").drop("later")


def episode_offsets(rows: DataFrame, by: str, strict: bool = False) -> DataFrame:
    """samples (length less one) and start offset of each recording, in order of its id.

    ``strict``: a recording of one frame is an error at run time. One row a
    recording reaches the unpartitioned window.
    """
    n = F.count(F.lit(1)) - 1
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a recording has a single frame")).cast("long")) if strict else n
    lengths = rows.groupBy(by).agg(n.alias("samples"))
    before = F.sum("samples").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return lengths.withColumn("first_sample", F.coalesce(before, F.lit(0)))


def redundant_targets(rows: DataFrame, episode: str, joint: str, order: list[str], position: str = "position", target: str = "target") -> DataFrame:
    """Whether every target of an episode is the joint's next position.

    Close means within 1e-6 and 1e-5 of the target's size. The last target of
    a joint has no next position and does not count; an episode without targets
    is redundant.
    """
    following = F.lead(position).over(_line([episode, joint], order))
    t = F.col(target)
    close = F.abs(F.col("following") - t) <= ABSOLUTE + RELATIVE * F.abs(t)
    checked = rows.withColumn("following", following)
    return checked.groupBy(episode).agg(F.coalesce(F.bool_and(F.when(F.col("following").isNotNull() & t.isNotNull(), close)), F.lit(True)).alias("redundant"))


def monotonic_violations(rows: DataFrame, by: list[str], order: list[str], ts: str) -> DataFrame:
    """Rows whose time is not after that of the row captured before them."""
    return rows.withColumn("previous", F.lag(ts).over(_line(by, order))).where(F.col(ts) <= F.col("previous"))


def step_clock(rows: DataFrame, by: list[str], order: list[str], base_us: Column, period_us: int, kept: Column | None = None) -> DataFrame:
    """Times of steps at a fixed rate, the first one period after the base.

    Rows that ``kept`` leaves out still take their slot. Adds step_us and the
    recording's stop_us, one period after its last step.
    """
    line = _line(by, order)
    out = rows.withColumn("step_us", base_us + F.row_number().over(line) * period_us)
    out = out.where(kept) if kept is not None else out
    return out.withColumn("stop_us", F.max("step_us").over(Window.partitionBy(*by)) + period_us)


def relative_clock(rows: DataFrame, by: list[str], ts: str, start: Column) -> DataFrame:
    """Times counted from a recording's first, never before its start."""
    first = F.first(ts).over(_line(by, ["arrival"]))
    return rows.withColumn("relative_us", start + F.greatest(F.lit(0), F.col(ts) - first))


def positional(rows: DataFrame, by: list[str], order: list[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows ``start:stop:step`` of each group, with negative ends counted from its end."""
    if step <= 0:
        raise ValueError("the step must be positive")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = rows.withColumn("at", F.row_number().over(_line(by, order)) - 1).withColumn("n", n)

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.least(F.lit(x), F.col("n")) if x >= 0 else F.greatest(F.col("n") + x, F.lit(0))

    first, last = bound(start, F.lit(0)), bound(stop, F.col("n"))
    inside = (F.col("at") >= first) & (F.col("at") < last) & ((F.col("at") - first) % step == 0)
    return placed.where(inside).drop("n").withColumn("at", F.col("at").cast("long"))


def element(rows: DataFrame, by: list[str], order: list[str], index: int) -> DataFrame:
    """The row at ``index`` of each group; fails at run time where there is none."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = rows.withColumn("at", F.row_number().over(_line(by, order)) - 1).withColumn("n", n)
    at = F.lit(index) if index >= 0 else F.col("n") + index
    wrong = (at < 0) | (at >= F.col("n"))
    return placed.where(F.when(wrong, F.raise_error(F.lit(f"index {index} is out of range")).cast("boolean")).otherwise(F.col("at") == at)).drop("at", "n")


def split_ranges(splits: DataFrame, start: int, stop: int) -> DataFrame:
    """(split, from_row, to_row) of the rows [start, stop) of concatenated splits (ord, split, size)."""
    ends = F.sum("size").over(Window.orderBy("ord"))
    placed = splits.withColumn("end", ends).withColumn("begin", F.col("end") - F.col("size"))
    inside = placed.where((F.col("begin") < stop) & (F.col("end") > start))
    return inside.select("split", F.greatest(F.lit(start) - F.col("begin"), F.lit(0)).alias("from_row"), F.least(F.lit(stop) - F.col("begin"), F.col("size")).alias("to_row"))


def contiguous_parts(rows: DataFrame, order: str, parts: int, total: int) -> DataFrame:
    """Part of each 0-based position: equal runs, what remains in the last."""
    each = max(total // parts, 1)
    return rows.withColumn("part", F.least(F.floor(F.col(order) / each), F.lit(parts - 1)).cast("long"))


def train_validation_split(rows: DataFrame, key: str, validation: float, seed: int) -> DataFrame:
    """Exactly int((1 - validation) * n) rows train, by a hash of their key.

    A split that leaves either side empty is an error at run time.
    The cut is found from counts of hash prefixes; only the rows of the one
    prefix that holds it are ranked.
    """
    hashed = rows.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    prefixes = hashed.groupBy(F.substring("h", 1, 3).alias("prefix")).count()
    line = Window.orderBy("prefix")
    prefixes = prefixes.select("prefix", "count", (F.sum("count").over(line) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("n"))
    train = F.floor(F.lit(1.0 - validation) * F.col("n"))
    train = F.when((train > 0) & (train < F.col("n")), train).otherwise(F.raise_error(F.lit("a side of the split is empty")).cast("long"))
    share = prefixes.select("prefix", "count", "before", train.alias("train"))
    placed = hashed.join(share, F.substring("h", 1, 3) == F.col("prefix"))
    cut = (F.col("before") < F.col("train")) & (F.col("train") < F.col("before") + F.col("count"))
    side = lambda trains: F.when(trains, "train").otherwise("validation")
    whole = placed.where(~cut).withColumn("split", side(F.col("before") < F.col("train")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("prefix").orderBy("h", key))
    parted = placed.where(cut).withColumn("split", side(rank <= F.col("train")))
    return whole.unionByName(parted).drop("h", "prefix", "count", "before", "train")


def random_timestep(lengths: DataFrame, key: str, length: str, seed: int) -> DataFrame:
    """A step of each episode but its last, the same for the same seed."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return lengths.withColumn("timestep", F.pmod(h, F.greatest(F.col(length) - 1, F.lit(1))).cast("long"))
