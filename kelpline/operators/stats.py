"""Statistics of slots, and aggregates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field(name: str):
    """Takes a field out of a struct, as a one-argument function."""
    return lambda s: s[name]


def dataset_statistics(values: DataFrame, by: list[str], value: str = "value", exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """count, mean, std (population), min, max, q01 and q99 of each group.

    ``exact`` quantiles interpolate and hold a group's distinct values in one
    task; without it, sketches that merge map-side take their place, for groups
    of any size.
    """
    v = F.col(value)
    q = (lambda p: F.percentile(v, F.lit(p))) if exact else (lambda p: F.percentile_approx(v, p, accuracy))
    return values.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), q(0.01).alias("q01"), q(0.99).alias("q99"),
    )


def vector_statistics(vectors: DataFrame, by: list[str], vector: str, exact: bool = True) -> DataFrame:
    """The same for every element of a vector column; null vectors have none."""
    return dataset_statistics(vectors.select(*by, F.posexplode(vector).alias("elem", "value")), [*by, "elem"], exact=exact)


def concatenated(stats: DataFrame, by: list[str], slot: str, columns: list[str]) -> DataFrame:
    """One row a group with each statistic as an array in the order of slots."""
    own = F.array_sort(F.collect_list(F.struct(slot, *columns)))
    rows = stats.groupBy(*by).agg(own.alias("s"))
    return rows.select(*by, *(F.transform("s", field(c)).alias(c) for c in columns))


def metric_average(metrics: DataFrame, step: str = "step", key: str = "key", value: str = "value") -> DataFrame:
    """Sum of each key over the number of steps that reported anything.

    Not the mean of a key's own values: a key that some steps leave out counts
    as 0 there.
    """
    steps = metrics.select(step).distinct().agg(F.count(F.lit(1)).alias("steps"))
    sums = metrics.groupBy(key).agg(F.sum(value).alias("total"))
    return sums.join(F.broadcast(steps)).select(key, (F.col("total") / F.col("steps")).alias("average"))


def linear_fit(points: DataFrame, by: list[str], x: str, y: str, rising: bool = False) -> DataFrame:
    """Least-squares slope and intercept of y on x, for each group.

    ``rising``: a slope that isn't positive is an error at run time.
    """
    fit = points.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    if rising:
        fit = fit.withColumn("slope", F.when(F.col("slope") > 0, F.col("slope")).otherwise(F.raise_error(F.lit("the slope is not positive")).cast("double")))
    return fit


def phase_summary(phases: DataFrame, phase: str, seconds: str, failed: str) -> DataFrame:
    """count, sum, mean, max and failures of each phase."""
    s = F.col(seconds)
    return phases.groupBy(phase).agg(F.count(F.lit(1)).alias("count"), F.sum(s).alias("total"), F.avg(s).alias("mean"), F.max(s).alias("longest"), F.count_if(F.col(failed)).alias("failures"))


def set_hash(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """A hash of each group's set of members, whatever their order."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ","), 256).alias("members_sha256"))
