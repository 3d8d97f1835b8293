"""Mixing sources to target weights along a curriculum.

Targets come from water-filling over the sources. Each source's documents are
laid end to end in a fixed pseudo-random order; the words that the target
demands are taken from that line (twice over where the target exceeds the
source), and the point at which a source's integrated weight schedule has
demanded a document's words is its training position.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.common import materialise, words_in

WEIGHTS = (5, 2, 1)
#: How a source's weight changes over training: w(t) = weight * (1 + slope * (2t - 1)).
SLOPES = (0.5, 0.0, -0.5)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """Adds place, weight, slope and target to (source, source_size) rows.

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source and
    the excess goes to the others by weight. With sources in order of cap over
    weight, the common level is the largest of the levels that result from
    capping the first few. One row a source: the unpartitioned windows see no
    documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") % len(values) + 1)
    s = sources.withColumn("place", place).withColumn("weight", pick(weights)).withColumn("slope", pick(slopes))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "place")
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    s = s.withColumn("level", (budget - capped) / rest)
    level = F.max("level").over(everything)
    return s.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("cap", "ratio", "level")


def position(demanded: Column, slope: Column) -> Column:
    """When a source's schedule has demanded this part of its target (0 to 1).

    Inverts the integral t(1 - slope) + slope * t**2 of the schedule. What lies
    beyond the target (over 1) keeps its own value, after all of training.
    """
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * F.least(demanded, F.lit(1.0)))
    inverse = F.when(slope == 0, demanded).otherwise((slope - 1 + root) / (2 * slope))
    return F.when(demanded >= 1, demanded).otherwise(inverse)


def plan(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, before, want, slope and, with ``whole``, the row itself."""
    named = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    row = [F.struct(*docs.columns).alias("row")] * whole
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), named.alias("named"), *row)
    # null-safe keys of plain equality: the window and the join then share one shuffle
    keys = ["no_source", "source_key", "part"]
    sized = sized.withColumns({"no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit("")), "part": F.substring("named", 1, 3)})
    sized = sized if whole else materialise(sized)
    parts = sized.groupBy("source", *keys).agg(F.sum("size").alias("part_size"))
    sources = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), share, most, weights, slopes)
    earlier = Window.partitionBy(*keys[:2]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", *keys, F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_before"))
    facts = parts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    line = Window.partitionBy(*keys).orderBy("named", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("inside", F.coalesce(F.sum("size").over(line), F.lit(0))).join(facts, keys)
    want = F.floor(F.col("target") + 0.5)
    before = F.col("part_before") + F.col("inside")
    rounds = [F.greatest(F.least(want - before - F.col("source_size") * k, F.col("size")), F.lit(0)) for k in range(most)]
    taken = rounds[0]
    for x in rounds[1:]:
        taken = taken + x
    return laid.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), before.alias("before"), want.alias("want"), "slope", "named", *["row"] * whole)


def middle(turn: int = 0) -> Column:
    """Position of the middle of a document in the ``turn``-th run over its source."""
    at = F.col("before") + F.col("source_size") * turn + F.col("size") / 2
    return F.round(position(F.when(F.col("want") > 0, at / F.col("want")).otherwise(F.lit(1.0)), F.col("slope")), 9)


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """doc_id, size, source_size, target, taken and position, sorted by position.

    Every row of ``docs`` is returned; taken is 0 for those that the mix
    leaves out, and their positions follow those of all others. Within a
    source, words are taken in the order of md5(doc_id), so the sum is the
    target to within a word, no document gives more than ``most`` times its
    size and reruns agree. Null and empty texts have size 0; a null source is
    a source of its own; repeated rows are taken each for itself; an empty
    table gives an empty result; other columns are ignored.

    Scale: running totals are kept within 4096 parts of each source and joined
    to the totals of the parts before, so a source with a third of all rows is
    dealt over 4096 window groups. Nothing is collected.
    """
    laid = plan(docs, share, most, weights, slopes).withColumn("position", middle())
    return laid.orderBy("position", "named", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


def apply(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, whole documents in training order.

    A document appears once for each run over its source that takes at least
    half of its words; texts stay whole, so a source's sum is off its target by
    half a document at most. A document without words appears once.
    """
    laid = plan(docs, share, most, weights, slopes, whole=True)
    share_of = [F.greatest(F.least(F.col("want") - F.col("before") - F.col("source_size") * k, F.col("size")), F.lit(0)) for k in range(most)]
    runs = [F.when(x * 2 >= F.col("size") if k else (x * 2 >= F.col("size")) | (F.col("size") == 0), middle(k)) for k, x in enumerate(share_of)]
    runs = [runs[0], *(F.when(F.col("size") > 0, x) for x in runs[1:])]
    out = laid.withColumn("position", F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())))
    return out.orderBy("position", "named", "doc_id").select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS named
  FROM documents
), sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sums
), weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][place % 3 + 1] AS slope, source_size * 2.0::DOUBLE AS cap FROM placed
), levels AS (
  SELECT *, ((SELECT sum(source_size)::BIGINT FROM sums) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (SELECT source, source_size, slope, least(cap, (SELECT max(level) FROM levels) * weight) AS target FROM levels
), laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, floor(t.target + 0.5::DOUBLE)::BIGINT AS want,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.named, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), asked AS (
  SELECT *, CASE WHEN want > 0 THEN (before + size / 2.0::DOUBLE) / want ELSE 1.0::DOUBLE END AS u FROM laid
)
SELECT doc_id, size, source_size, target,
       (greatest(least(want - before, size), 0) + greatest(least(want - before - source_size, size), 0))::BIGINT AS taken,
       round(CASE WHEN u >= 1 THEN u WHEN slope = 0 THEN u
             ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(u, 1.0::DOUBLE))) / (2 * slope) END, 9) AS position
FROM asked
"""
