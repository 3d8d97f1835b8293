"""SimHash fingerprints and their near-duplicate components.

Candidates come from a generalised pigeonhole: the 64 bits are grouped into
partitions of correlated bits, each partition gets its own threshold, and two
fingerprints within the distance must agree up to the threshold in at least one
partition. Thresholds are allocated by dynamic programming on candidate counts
estimated over all fingerprints.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import Workspace, materialise, shared_dir

BITS = 64
#: Members of a bucket that one task compares; larger buckets go by shared neighbours.
BUCKET = 2048
#: Members of a component, and their shingles, that one task settles; larger ones are dealt out and lose copies in rounds.
MEMBERS, SHINGLES = 512, 500_000
#: A round goes on where it leaves at most this share of what it was given.
SHRUNK = 0.75
#: Bytes of text in a bucket of the table of distinct texts.
TEXT_BYTES = 16 << 20
#: Links for each file of a round's table.
FILE_ROWS = 250_000
#: Texts sampled for the order of shingles, and the common ones kept; both change the number of candidates only.
SAMPLE, COMMON = 8192, 1 << 16
#: Bits of a text's parities: at least, and at most (longer texts still meet, but more of their pairs are checked).
PARITY, PARITY_MOST = 1024, 1 << 14
#: What a shuffled row costs, in comparisons of two fingerprints.
ROW_COST = 500
_CHUNK = 1 << 15


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text (0 where it has no word)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return 0
    if len(own) < words:
        return digest(b" ".join(own), seed)
    ends = np.cumsum([len(w) + 1 for w in own])
    joined = b" ".join(own)
    starts = np.concatenate([[0], ends])[: len(own) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    ones, n = np.zeros(BITS, dtype=np.int64), len(stops)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the unsigned fingerprint as a long) of whole texts.

    A-Z is lower-cased; words are runs of anything but ASCII white space. Null
    and empty texts get 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------- partitions, thresholds


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), _CHUNK):
                own = bits[at : at + _CHUNK]
                both += own.T @ own
            n += len(bits)
        flat = np.concatenate([[n], both.ravel()]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])

    flat = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for at, n in fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").sum("n").collect():
        flat[at] = n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(tied, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        own = [max(left, key=lambda b: (tied[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (tied[b, own].sum(), -b)))
            left.discard(own[-1])
        groups.append(sorted(own))
    return groups


def within(disagree: np.ndarray, most: int) -> np.ndarray:
    """Chance of at most t disagreeing bits, for t up to ``most``."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in disagree:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance)


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """A threshold for each partition (-1: not probed) at the least cost.

    ``costs[i][t]``: estimated candidates of partition i under threshold t. The
    thresholds plus one sum to distance + 1, so a pair that exceeds every
    threshold differs in more than ``distance`` bits.
    """
    need = distance + 1
    table: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * need
    for cost in costs:
        grown: list[tuple[float, list[int]] | None] = [None] * (need + 1)
        for used, old in enumerate(table):
            if old is None:
                continue
            for t in range(-1, len(cost)):
                if used + t + 1 > need:
                    break
                own = old[0] + (cost[t] if t >= 0 else 0.0)
                if grown[used + t + 1] is None or own < grown[used + t + 1][0]:
                    grown[used + t + 1] = (own, [*old[1], t])
        table = grown
    return table[need][1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def probes(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Bit masks: two fingerprints within a threshold agree under one of its masks."""
    masks = []
    for bits, t in zip(groups, thresholds, strict=True):
        whole = sum(1 << b for b in bits)
        masks += [whole & ~sum(1 << b for b in out) for out in combinations(bits, t)] if t >= 0 else []
    return masks


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: tag, value, fp."""
    keys = F.array(*[F.struct(F.lit(k).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("key")).select("key.tag", "key.value", "fp")


def chosen_masks(fps: DataFrame, distance: int, parts: tuple[int, ...], bucket: int = BUCKET) -> list[int]:
    """Masks for the fingerprints at hand, from counts over all of them.

    ``parts``: numbers of partitions to weigh against each other.

    What a partition costs under a threshold: the comparisons within its
    buckets, as counted for threshold 0 (a large bucket costs its shared
    neighbours instead) and scaled to higher thresholds by how often its bits
    disagree, and the rows for its masks, each as dear as ROW_COST comparisons.
    """
    n, both = co_occurrence(fps)
    p = np.diag(both) / max(n, 1)
    c = F.col("count").cast("double")
    cost = F.when(c > bucket, c * (BITS + 1) * ROW_COST).otherwise(c * (c - 1) / 2)
    best: tuple[float, list[int]] | None = None
    for m in parts:
        groups = grouped_bits(n, both, m)
        whole = keyed(fps, probes(groups, [0] * m)).groupBy("tag", "value").count()
        counted = {r[0]: float(r[1]) for r in whole.groupBy("tag").agg(F.sum(cost)).collect()}
        costs = []
        for k, bits in enumerate(groups):
            reach = within(2 * p[bits] * (1 - p[bits]), distance)
            costs.append([(counted.get(k, 0.0) + 1) * reach[t] / max(reach[0], 1e-12) + ROW_COST * n * comb(len(bits), t) for t in range(min(distance, len(bits)) + 1)])
        thresholds = allocate(costs, distance)
        total = sum(costs[k][t] for k, t in enumerate(thresholds) if t >= 0)
        if best is None or total < best[0]:
            best = (total, probes(groups, thresholds))
    return best[1]


# -------------------------------------------------------------------- links


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``fps`` within ``distance``."""
    root = np.arange(len(fps))
    links = []
    bits = fps.view(np.uint64)
    for i in range(len(bits) - 1):
        near = i + 1 + np.nonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= distance)[0]
        near = near[root[near] != root[i]]
        while len(near):
            j = near[0]
            links.append((int(fps[i]), int(fps[j])))
            root[root == root[j]] = root[i]
            near = near[root[near] != root[i]]
    return links


def _verified(groups: DataFrame, distance: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            links = [x for own in batch.column(0) for x in forest(np.unique(own.values.to_numpy()), distance)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=schema)

    return groups.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = 2, parts: tuple[int, ...] = (3,), bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) within ``distance`` that span every component of ``fps``.

    Buckets of up to ``bucket`` fingerprints are compared in one task each.
    Larger ones are matched just as exactly in other ways. Up to distance 2,
    two fingerprints link only if a point within one bit of both exists, and at
    most 65 lie around a point. Beyond, a bucket is dealt into chunks and every
    two chunks meet in a task of their own.
    """
    keys = keyed(fps, chosen_masks(fps, distance, parts, bucket))
    large = materialise(keys.groupBy("tag", "value").count().where(F.col("count") > bucket))
    some = not large.isEmpty()
    few = keys.join(large, ["tag", "value"], "left_anti") if some else keys
    own = few.groupBy("tag", "value").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1).select("own")
    if some and distance <= 2:
        points = F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(BITS)])
        around = keys.join(large, ["tag", "value"], "left_semi").select("fp").distinct().select("fp", F.explode(points).alias("flip"))
        around = around.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_list("fp").alias("own"))
        own = own.unionByName(around.where(F.size("own") > 1).select("own"))
    elif some:
        chunks = F.ceil(F.col("count") / bucket).cast("long")
        dealt = keys.join(large, ["tag", "value"]).withColumn("mine", F.pmod(F.xxhash64("fp"), chunks)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
        met = dealt.groupBy("tag", "value", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two")).agg(F.collect_list("fp").alias("own"))
        own = own.unionByName(met.select("own"))
    return _verified(own, distance).distinct()


def components(edges: DataFrame, keep=materialise) -> DataFrame:
    """(node, parent): the smallest node of each node's component.

    Hooking and pointer jumping; rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder and reread; the driver
    sees one count a round. ``keep`` writes a table and reads it back.
    """
    both = keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    files = max(1, -(-both.count() // FILE_ROWS))  # a round of few links takes few tasks and files
    own = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"))
    own = keep(own.coalesce(files))
    while True:
        jump = own.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        level = own.join(jump, "parent")
        heard = both.join(level.select(F.col("node").alias("v"), "over"), "v").groupBy(F.col("u").alias("node")).agg(F.min("over").alias("heard"))
        level = level.join(heard, "node").select("node", "parent", "over", F.least("over", "heard").alias("least"))
        hook = level.groupBy("parent").agg(F.min("least").alias("hooked")).select(F.col("parent").alias("node"), "hooked")
        level = level.join(hook, "node", "left").select("node", F.col("parent").alias("old"), F.least("least", F.coalesce("hooked", "least")).alias("parent"))
        level = keep(level.coalesce(files))
        moved = level.where("old <> parent").limit(1).count()
        own = level.select("node", "parent")
        if not moved:
            return own


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, parts: tuple[int, ...] = (3,)) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    component_id is the smallest doc_id reachable through fingerprints that
    differ in at most ``distance`` bits, the document's own included. Null and
    empty texts share the fingerprint 0 and link like any other. Rows with a
    null doc_id are kept and count for no component_id (null if a component has
    nothing else). Repeated rows are kept; other columns are ignored.

    Scale: texts are read once; after that only (doc_id, fp) rows move. Copies
    collapse to one fingerprint by partial aggregation before any join, and the
    last join brings them back, where adaptive execution splits a fingerprint
    that many documents share.
    """
    fp = materialise(fingerprints(docs, words))
    distinct = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(distinct.select("fp"), distance, parts))
    of = linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "parent", "first")
    least = of.groupBy("parent").agg(F.min("first").alias("component_id"))
    named = of.select("fp", "parent").join(least, "parent").select("fp", "component_id")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fp.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------------ deduplication


#: Odd multipliers of the words of a shingle, and of the last mixing of its hash.
_PLACE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order, A-Z in lower case."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 42) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)


def shingle_hashes(text: str | np.ndarray | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (fewer words: of all of them; none: 0)."""
    own = text if isinstance(text, np.ndarray) else word_hashes(text)
    if not len(own):
        return np.zeros(1, dtype=np.int64)
    width = min(words, len(own))
    h = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(_PLACE) + own[k : len(own) - width + 1 + k]
        h ^= h >> np.uint64(29)
    h = h * np.uint64(_MIX)
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes: the bits that over half of them have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, first and row: of each text the row with the smallest doc_id, with all its columns.

    A table in the shared folder, in buckets by ``key`` (a hash of the text with
    the doc_id): later joins by key don't move the texts again. Rows of one
    text differ in their keys, so a text that many documents share is spread;
    all but one of them go in the join with the smallest doc_ids.
    """
    spark = docs.sparkSession
    copy = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(copy.alias("copy"), F.col("doc_id").cast("long").alias("first"), F.struct(*docs.columns).alias("row"))
    key = F.concat_ws(":", "copy", F.coalesce(F.col("first").cast("string"), F.lit("-")))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # as many as a join of both sides deals out at least, so that each task writes one bucket; 100,000 is Spark's limit
    buckets = int(min(max(-(-size // TEXT_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000))
    least = own.groupBy("copy").agg(F.min("first").alias("first")).select(key.alias("key"))
    held = own.select(key.alias("key"), "first", "row").repartition(buckets, "key")
    # an inner join: the optimiser would take a semi join before the shuffle, which then moves the texts twice
    held = held.join(least.repartition(buckets, "key"), "key").dropDuplicates(["key"])
    name = f"kelpline_{uuid.uuid4().hex}"
    held.write.bucketBy(buckets, "key").sortBy("key").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files stay
    return out


def sketched(unique: DataFrame, similarity: float, words: int) -> DataFrame:
    """key, id, first, two fingerprints, number of shingles, parities and prefix of each text.

    ``fp`` is the fingerprint of the set of words, ``other`` that of the set of
    shingles; ``id`` is a hash of the key (equal ids only cost comparisons).
    """
    text = F.col("row.text").cast("string")
    common, counts = common_shingles(unique, words)
    schema = pa.schema([("key", pa.string()), ("id", pa.int64()), ("first", pa.int64()), ("fp", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # bounds what a worker holds besides the batch
                batch = whole.slice(at, 512)
                fps, shingles = [[], []], []
                for t in batch.column(3):
                    own = word_hashes(t.as_py())
                    shingles.append(shingle_hashes(own, words))
                    for k, x in enumerate((np.unique(own), shingles[-1])):
                        fps[k].append(majority(x))
                signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in fps]
                prefixes = [prefix_of(x, similarity, common, counts) for x in shingles]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *signed, pa.array([len(x) for x in shingles], pa.int64()), pa.array(map(parities, shingles), pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], schema=schema)

    ddl = "key string, id long, first long, fp long, other long, n long, bits binary, prefix array<long>"
    return unique.select("key", F.xxhash64("key").alias("id"), "first", text.alias("text")).mapInArrow(run, ddl)


def joined(n: int, near) -> np.ndarray:
    """For each of ``n`` members of a bucket, the first member that it is connected to.

    ``near(i, others)``: which of the others are near member i. A member that
    has been reached is compared with those only that have not been, so copies
    of one text take a comparison each.
    """
    label, left = np.arange(n), np.arange(n)
    while len(left):
        first, reached, left = left[0], [left[0]], left[1:]
        while reached and len(left):
            hit = near(reached.pop(), left)
            label[left[hit]] = first
            reached += left[hit].tolist()
            left = left[~hit]
    return label


def fingerprint_near(distance: int, other_distance: int):
    """Nearness of (id, fp, other) items by both fingerprints."""

    def of(items: pa.StructArray):
        a, b = (items.field(k).to_numpy().view(np.uint64) for k in (1, 2))
        return lambda i, others: (np.bitwise_count(a[others] ^ a[i]) <= distance) & (np.bitwise_count(b[others] ^ b[i]) <= other_distance)

    return of


def parity_near(similarity: float):
    """Nearness of (id, n, bits) items: whether sizes and parities allow the similarity.

    Parities of two widths are compared at the narrower: halves of the wider
    are folded onto each other.
    """

    def of(items: pa.StructArray):
        n = items.field(1).to_numpy()
        held = items.field(2).to_pylist()
        width = np.array([len(b) for b in held])
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a width: a row for each item as wide, and its place
        above, rows = np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.uint64)
        for w in np.unique(width)[::-1].tolist():
            while len(above) and rows.shape[1] * 8 > w:
                half = rows.shape[1] // 2
                rows = rows[:, :half] ^ rows[:, half:]
            own = np.nonzero(width == w)[0]
            new = np.frombuffer(b"".join(held[k] for k in own), dtype=np.uint64).reshape(len(own), -1)
            above, rows = np.concatenate([above, own]), np.concatenate([rows, new]) if len(above) else new
            place = np.zeros(len(n), dtype=np.int64)
            place[above] = np.arange(len(above))
            folded[w] = rows, place

        def near(i: int, others: np.ndarray) -> np.ndarray:
            out = np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-9
            fit = others[out]
            apart, common = np.zeros(len(fit), dtype=np.int64), np.minimum(width[fit], width[i])
            for w, (bits, place) in folded.items():
                at = np.nonzero(common == w)[0]
                if len(at):
                    apart[at] = np.bitwise_count(bits[place[fit[at]]] ^ bits[place[i]]).sum(axis=1, dtype=np.int64)
            out[out] = apart <= (n[fit] + n[i]) * ((1 - similarity) / (1 + similarity)) + 1e-9
            return out

        return near

    return of


def fingerprint_keys(items: DataFrame, distance: int, parts: tuple[int, ...]) -> DataFrame:
    """(tag, value, item) rows for the probes of the generalised pigeonhole on ``fp``."""
    masks = chosen_masks(items.select("fp"), distance, parts)
    keys = F.array(*[F.struct(F.lit(k).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)])
    return items.select(F.struct("id", "fp", "other").alias("item"), F.explode(keys).alias("key")).select("key.tag", "key.value", "item")


def prefix_keys(items: DataFrame, keep=materialise) -> DataFrame:
    """(tag, value, item) rows for the shingles that prefixes of several texts share.

    Of shingles that the same texts share (as those of near copies are), one
    stands for all: they are told by sums over the texts, not by lists. Few
    shingles of prefixes are shared: the others go before any of this.
    """
    # the filters make both uses alike in the eyes of the optimiser, so one shuffle serves them
    spread = items.where("id is not null").select("id", F.explode("prefix").alias("value")).where("value is not null").repartition("value")
    seen = spread.groupBy("value").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    member = keep(spread.join(seen.where("low < high").select("value"), "value"))
    lists = member.groupBy("value").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mixed"), F.count(F.lit(1)).alias("c"))
    one = lists.groupBy("low", "high", "mixed", "c").agg(F.min("value").alias("value")).select("value")
    own = member.join(one, "value").join(items.select("id", "n", "bits"), "id")
    return own.select(F.lit(0).alias("tag"), "value", F.struct("id", "n", "bits").alias("item"))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _each_bucket(own: DataFrame, links_of) -> DataFrame:
    """Links of buckets (own: a list of items whose first field is the id)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            held, ends = lists.flatten(), np.cumsum([0, *(len(x) for x in lists)])
            ids = held.field(0).to_numpy()
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for at, end in zip(ends, ends[1:], strict=False):
                # by id: whatever the bucket, a group's links lead to its smallest member there
                order = at + np.argsort(ids[at:end], kind="stable")
                a, b = links_of(held.take(pa.array(order)))
                out.append((ids[order[a]], ids[order[b]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_LINK)

    return own.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def bucket_links(keys: DataFrame, near, salt: int | None = None, keep=materialise) -> tuple[DataFrame, bool]:
    """Links (a, b) that connect what ``near`` connects within buckets, and whether any was large.

    A bucket of more than BUCKET rows is dealt out by ``salt``, each part
    linked for itself. Without a salt every two parts meet too, so no link is
    missed; that is for what rounds with salts have left.
    """
    sizes = keys.groupBy("tag", "value").count()
    large = keep(sizes.where(F.col("count") > BUCKET))
    some = not large.isEmpty()
    few = keys.join(large, ["tag", "value"], "left_anti") if some else keys
    own = few.groupBy("tag", "value").agg(F.collect_list("item").alias("own")).where(F.size("own") > 1).select("own")
    if some:
        parts = F.ceil(F.col("count") / (BUCKET if salt is None else BUCKET / 2)).cast("long")
        dealt = keys.join(large, ["tag", "value"]).withColumn("mine", F.pmod(F.xxhash64("item.id", F.lit(salt or 0)), parts))
        if salt is None:
            dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("met"))
            met = dealt.groupBy("tag", "value", F.least("mine", "met").alias("one"), F.greatest("mine", "met").alias("two"))
        else:
            met = dealt.groupBy("tag", "value", "mine")
        own = own.unionByName(met.agg(F.collect_list("item").alias("own")).select("own"))

    def spanning(items: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        label = joined(len(items), near(items))
        return np.arange(len(items)), label

    return _each_bucket(own, spanning), some


def common_shingles(unique: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several texts of a sample hold, sorted, and their counts."""
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches):
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), words))], schema=schema)

    share = max(1, unique.count() // SAMPLE)
    held = unique.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select(F.col("row.text").cast("string").alias("text"))
    top = held.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    top.sort()
    return np.array([r[0] for r in top], dtype=np.int64), np.array([r[1] for r in top], dtype=np.int64)


def prefix_of(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in one order for all texts, of which two texts of the similarity share at least one.

    Two such texts share at least ``similarity`` of either's shingles, so the
    first that they share stands among the rest and one more. Any order of all
    shingles does; rare ones first gives few candidates.
    """
    rank = np.zeros(len(shingles), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    least = int(np.ceil(similarity * len(shingles) - 1e-9))
    return shingles[np.lexsort((shingles, rank))[: len(shingles) - least + 1]]


def parities(shingles: np.ndarray) -> bytes:
    """Bits: for each, whether an odd number of shingles falls on it.

    Two sets differ in at least as many shingles as these differ in bits. The
    width, a power of 2, grows with the set: of many more shingles than bits,
    half of the bits differ, which rules out no long texts.
    """
    width = min(max(PARITY, 1 << (len(shingles) - 1).bit_length()), PARITY_MOST)
    odd = np.bincount(shingles.view(np.uint64) % np.uint64(width), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def settled(first, text, similarity: float, words: int) -> list[int]:
    """Which of a group's texts go, each near one before it in order of doc_id that stays.

    Leaders are found through the shingles that they share with a document.
    """
    order = sorted(range(len(text)), key=lambda i: (first[i] is not None, first[i] or 0, text[i] or ""))
    sets = [shingle_hashes(text[i], words) for i in order]
    sizes = [len(x) for x in sets]
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(count[place] > 1, place, -1)  # what one text alone holds tells nothing
    holders: dict[int, list[int]] = {}
    gone, end = [], 0
    for k, i in enumerate(order):
        own, end = place[end : end + sizes[k]], end + sizes[k]
        own = own[own >= 0].tolist()
        shared = Counter(leader for x in own for leader in holders.get(x, ()))
        if any(n >= similarity * (sizes[k] + sizes[leader] - n) for leader, n in shared.items()):
            gone.append(i)
            continue
        for x in own:
            holders.setdefault(x, []).append(k)
    return gone


def collapsed(space: Workspace, unique: DataFrame, items: DataFrame, links: DataFrame, similarity: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(key) of the texts that go by these links, and (key, id) of those left in components that never met in one task.

    Within a component, a text goes if its shingles have the similarity to
    those of one that stays. Components of over MEMBERS texts or SHINGLES
    shingles are dealt into groups of that size, each settled in a task; what
    is left of them is dealt out anew, until a round leaves over SHRUNK of it.
    """
    label = components(links, space.keep)
    open_ = space.keep(items.select("key", "id", "first", "n").join(label.select(F.col("node").alias("id"), "parent"), "id"))
    gone: list[DataFrame] = []
    turn = 0
    while True:
        size = open_.groupBy("parent").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).alias("groups"))
        dealt = open_.join(size, "parent").withColumn("sub", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("groups")))
        texts = unique.select("key", F.col("row.text").cast("string").alias("text")).join(dealt.select("key", "first", "parent", "sub").hint("shuffle_hash"), "key")

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            first = [None if x != x else int(x) for x in pdf["first"].tolist()]
            out = settled(first, pdf["text"].tolist(), similarity, words)
            return pd.DataFrame({"key": pdf["key"].iloc[out]}, dtype=object)

        gone.append(space.keep(texts.groupBy("parent", "sub").applyInPandas(settle, "key string")))
        large = dealt.where("groups > 1").select("key", "id", "first", "n", "parent")
        left = space.keep(large.join(gone[-1], "key", "left_anti"))
        before, after = large.count(), left.count()
        if not after or after > SHRUNK * before:
            break
        open_, turn = left, turn + 1
    # a component that has shrunk to one group was settled as a whole
    return functools.reduce(DataFrame.unionByName, gone), left.select("key", "id")


def checked_pairs(space: Workspace, unique: DataFrame, items: DataFrame, near, similarity: float, words: int) -> DataFrame:
    """(a, b) ids of all pairs of ``items`` whose shingles have the similarity.

    Pairs come from shared shingles of prefixes, bounded by sizes and parities,
    and are checked one by one. For what rounds of `collapsed` could not reduce:
    texts that are mostly unlike each other.
    """

    def every(held: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        of, order = near(held), np.arange(len(held))
        found = [i + 1 + np.nonzero(of(i, order[i + 1 :]))[0] for i in order]
        return np.repeat(order, [len(f) for f in found]), np.concatenate(found)

    keys = space.keep(prefix_keys(items, space.keep))
    parts = F.ceil(F.col("c") / BUCKET).cast("long")
    dealt = keys.join(keys.groupBy("tag", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), ["tag", "value"]).withColumn("mine", F.pmod(F.xxhash64("item.id"), parts))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("met"))
    met = dealt.groupBy("tag", "value", F.least("mine", "met").alias("one"), F.greatest("mine", "met").alias("two")).agg(F.collect_list("item").alias("own")).select("own")
    pairs = space.keep(_each_bucket(met, every))
    # of these items alone: the table of all texts stays where it is
    texts = unique.select("key", F.col("row.text").cast("string").alias("text")).join(items.select("key", "id").hint("shuffle_hash"), "key").select("id", "text")
    of = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"))
    whole = pairs.join(of("a"), "a").join(of("b"), "b")

    def check(batches):
        for batch in batches:
            sets = [[shingle_hashes(t.as_py(), words) for t in batch.column(k)] for k in (2, 3)]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            near = [n >= similarity * (len(x) + len(y) - n) for n, x, y in zip(both, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], schema=_LINK)

    return whole.select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long")


def dominated(space: Workspace, pairs: DataFrame) -> DataFrame:
    """(id) of the nodes outside an independent set that no further node can join.

    Each round takes the nodes that come before all their neighbours in a
    random order; rounds grow with the logarithm of the number of pairs.
    """
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    edges = space.keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    gone: list[DataFrame] = []
    while not edges.isEmpty():
        chosen = edges.groupBy("a").agg(F.min(rank("b")).alias("least")).where(rank("a") < F.col("least")).select("a")
        gone.append(space.keep(edges.join(chosen, "a").select(F.col("b").alias("id")).distinct()))
        settled_ = chosen.select(F.col("a").alias("id")).unionByName(gone[-1])
        left = edges.join(settled_.select(F.col("id").alias("a")), "a", "left_anti").join(settled_.select(F.col("id").alias("b")), "b", "left_anti")
        edges = space.keep(left.select("a", "b"))
    return functools.reduce(DataFrame.unionByName, gone) if gone else edges.select(F.col("a").alias("id"))


def deduplicate(docs: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 4, other_distance: int = 16, parts: tuple[int, ...] = (4, 5, 6)) -> DataFrame:
    """One document of each group of near copies, with all its columns.

    Near copies: sets of ``words``-word shingles with a Jaccard similarity of at
    least ``similarity``. First pass: candidates by SimHash, fingerprints of the
    sets of words within ``distance`` bits (found by the generalised pigeonhole)
    and of shingles within ``other_distance``; each is checked, and copies go. Second pass, as fingerprints miss copies with contiguous edits: of what
    is left, all texts that share a shingle of their prefixes and whose sizes
    and parities allow the similarity. These are bounds, so no two documents
    that stay have the similarity. Every document that goes is a checked near
    copy of one that stays or that went for another. Of equal texts the smallest
    doc_id stays, once; null and empty texts are equal; other columns, whatever
    their names, are kept; an empty table gives an empty result.

    Scale: the texts are shuffled once, into buckets by a hash. Besides them a
    row for about a fifth of the shingles of what the first pass left moves.
    No group, bucket or component is held by one task beyond a fixed size:
    larger ones are dealt out in rounds while these shrink them; only of what
    is unlike and still shares a shingle with over BUCKET texts do all parts
    meet. Tables of the passes are deleted at the end; the distinct texts and
    the keys of those that go stay in the shared folder for the result.
    """
    spark = docs.sparkSession
    space, kept = Workspace(spark), Workspace(spark)
    unique = distinct_texts(docs)
    items = space.keep(sketched(unique, similarity, words))
    gone: list[DataFrame] = []

    def narrowed(by: DataFrame, how: str) -> None:
        """Carries on with a part of the items, in new tables."""
        nonlocal space, items
        after = Workspace(spark)
        items = after.keep(items.join(by, "key", how))
        space.drop()
        space = after

    def passes(keys_of, near, salted: bool = True) -> tuple[DataFrame, bool]:
        """Rounds of links and checks: what large components have left, and whether a bucket was large."""
        for turn in range(1 << 30):
            links, large = bucket_links(space.keep(keys_of(items)), near, turn if salted else None, space.keep)
            went, stuck = collapsed(space, unique, items, space.keep(links), similarity, words)
            gone.append(kept.keep(went))
            stuck, before = kept.keep(stuck), items.count()
            if not (salted and large and gone[-1].count() >= (1 - SHRUNK) * before):
                return stuck, large
            narrowed(gone[-1], "left_anti")

    passes(lambda own: fingerprint_keys(own, distance, parts), fingerprint_near(distance, other_distance))
    narrowed(gone[-1], "left_anti")
    bound = parity_near(similarity)
    stuck, large = passes(lambda own: prefix_keys(own, space.keep), bound)
    if large:  # what is left of large buckets: now all their parts meet
        narrowed(gone[-1], "left_anti")
        stuck, _ = passes(lambda own: prefix_keys(own, space.keep), bound, salted=False)
    if not stuck.isEmpty():
        narrowed(stuck.select("key"), "left_semi")
        out = dominated(space, checked_pairs(space, unique, items, bound, similarity, words))
        gone.append(kept.keep(items.join(out, "id", "left_semi").select("key")))
    every = functools.reduce(DataFrame.unionByName, gone)
    space.drop()
    return unique.join(every.hint("shuffle_hash"), "key", "left_anti").select("row.*")
