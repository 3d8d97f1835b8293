"""Exact top-k by inner product, over vectors sorted by length.

Vectors are rotated onto the principal axes of the corpus, so that a partial
sum over the first axes carries most of a product and Cauchy-Schwarz bounds
the rest tightly. Every query first gets a threshold from the longest vectors.
The corpus is written once as shards of descending length; each block of
queries then reads the shards in that order, carries its thresholds along and
stops where no vector that is left can be long enough.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.common import materialise, shared_dir

#: Longest vectors that set the first thresholds; rows of a block; leading axes of a partial sum.
SEEDS, BLOCK, AXES = 2048, 1024, 16
#: Bytes of the vectors of a shard, and of a block of queries, that a task holds.
SHARD_BYTES, QUERY_BYTES = 32 << 20, 32 << 20
_EXACT = float(1 << 53)


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, v (array of floor(scale * x), as doubles) and norm of usable vectors.

    Unusable: a null vec_id or vector, or null or non-finite components. Rows
    that share a vec_id stay apart: ``row`` tells them from each other once the
    result is written.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(finite, F.lit(False)))
    # floor() of a double is a long in Spark and saturates; rint keeps large values as doubles
    whole = F.transform("x", lambda e: F.when(F.abs(e) * scale < _EXACT, F.floor(e * scale).cast("double")).otherwise(e * scale))
    one = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == len(column) * width and (len(column) == 0 or (np.diff(column.offsets.to_numpy()) == width).all()):
            return flat.reshape(len(column), width)
    lists = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all vectors, largest first, from their summed products."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "s"])

    gram = np.zeros(width * width)
    for at, s in vectors.select("v").mapInArrow(run, "at long, s double").groupBy("at").sum("s").collect():
        gram[at] = s
    _, axes = np.linalg.eigh(gram.reshape(width, width))
    return axes[:, ::-1].copy()


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors.

    Doubles are exact while every sum stays under 2**53; larger values go
    through Python's integers and end at the bounds of a long.
    """
    if not queries.size or not block.size:
        return np.zeros((len(queries), len(block)), dtype=np.int64)
    if np.abs(queries).max() * np.abs(block).max() * queries.shape[1] < _EXACT:
        return (queries @ block.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (queries, block)]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(sum(a * b for a, b in zip(q, c, strict=True)), low), high) for c in whole[1]] for q in whole[0]], dtype=np.int64)


class Best:
    """The k best (score, vec_id) of each query row; ties go to the smaller id."""

    def __init__(self, rows: np.ndarray, k: int, least: np.ndarray):
        self.rows, self.k, self.least = rows, k, least.astype(float)
        self.scores: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(rows)
        self.found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(rows)

    def add(self, q: int, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.least[q]) & (rows != self.rows[q])
        if not fit.any():
            return
        s, f = np.concatenate([self.scores[q], scores[fit]]), np.concatenate([self.found[q], ids[fit]])
        keep = np.lexsort((f, -s))[: self.k]
        self.scores[q], self.found[q] = s[keep], f[keep]
        if len(keep) == self.k:
            self.least[q] = max(self.least[q], float(s[keep[-1]]))


def search(queries: np.ndarray, best: Best, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray) -> None:
    """Meet the candidates in blocks of descending length and keep the best.

    A block whose longest vector cannot reach a query's threshold ends the
    search for that query. Within a block, the product over the leading axes
    plus the product of what remains of both lengths bounds a score from above.
    """
    order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    norms, q_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    lead = axes[:, :AXES]
    q_lead = queries @ lead
    q_rest = np.sqrt(np.maximum(q_norms**2 - (q_lead**2).sum(1), 0))
    for at in range(0, len(ids), BLOCK):
        own, own_norms = vectors[at : at + BLOCK], norms[at : at + BLOCK]
        reach = q_norms * own_norms[0]
        alive = np.nonzero(reach * (1 + 1e-9) + 1e-6 >= best.least)[0]
        if not len(alive):
            break
        c_lead = own @ lead
        c_rest = np.sqrt(np.maximum(own_norms**2 - (c_lead**2).sum(1), 0))
        bound = q_lead[alive] @ c_lead.T + np.outer(q_rest[alive], c_rest)
        bound += 1e-7 * np.outer(q_norms[alive], own_norms) + 1e-6
        near = bound >= best.least[alive][:, None]
        hit, gaining = np.nonzero(near.any(axis=0))[0], np.nonzero(near.any(axis=1))[0]
        if not len(hit):
            continue
        scores = products(queries[alive[gaining]], own[hit])
        for row, q in enumerate(alive[gaining]):
            best.add(q, scores[row], rows[at + hit], ids[at + hit])


def written_by_length(own: DataFrame, shards: int) -> tuple[str, list[tuple[str, float]]]:
    """Shards of descending length in the shared folder: their folder, and each one's file and greatest length.

    Vectors of one length are dealt over shards by row.
    """
    path = f"{shared_dir(own.sparkSession)}/kelpline-{uuid.uuid4().hex}"
    falling = [F.desc("norm"), "row"]
    own.repartitionByRange(shards, *falling).sortWithinPartitions(*falling).write.parquet(path)
    name = F.col("_metadata.file_path")
    files = own.sparkSession.read.schema(own.schema).parquet(path).groupBy(name.alias("file")).agg(F.max("norm").alias("norm")).collect()
    return path, sorted(((f, float(n)) for f, n in files), key=lambda x: (-x[1], x[0]))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` highest scores.

    Queries: rows whose vec_id is divisible by ``every``; candidates: all rows
    but the query's own. Score: inner product of floor(scale * x), shorter
    vectors padded by zeros; ties go to the smaller vec_id. Rows that share a
    vec_id are candidates (and queries, each with ranks of its own) apart. An
    empty table gives an empty result, vectors without components score 0;
    other columns are ignored.

    Scale: the corpus is shuffled once, by length, however many queries there
    are. A task holds a block of queries and one shard at a time, both bounded
    in bytes, and reads shards from the shared folder (one that pyarrow can
    open) only while one of its queries can still gain. Where the blocks are
    too few for the cluster, the shards are dealt to several tasks a block. The
    driver holds SEEDS vectors, the axes and a line for each shard.
    """
    own = materialise(prepared(vectors, scale))
    spark = own.sparkSession
    n, width, asked = own.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    ddl = "query_row long, query_id long, vec_id long, score long"
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    axes = rotation(own, width)
    seeds = own.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).toArrow()
    seed_rows, seed_ids, seed_vectors = seeds.column("row").to_numpy(), seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v"), width)
    path, files = written_by_length(own, max(1, -(-n * width * 8 // SHARD_BYTES)))
    groups = max(1, -(-asked * width * 8 // QUERY_BYTES))
    stripes = min(len(files), max(1, -(-2 * spark.sparkContext.defaultParallelism // groups)))

    def first_thresholds(batches):
        for batch in batches:
            rows, q = batch.column(0).to_numpy(), _matrix(batch.column(2), width)
            best = Best(rows, k, np.full(len(rows), -np.inf))
            search(q, best, seed_rows, seed_ids, seed_vectors, axes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.least)], names=["row", "vec_id", "v", "least"])

    queries = own.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v").mapInArrow(first_thresholds, "row long, vec_id long, v array<double>, least double")
    stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")
    dealt = queries.select("*", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("block"), stripe)

    def meet(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        rows, q = asked["row"].to_numpy(), _matrix(asked["v"], width)
        best, longest = Best(rows, k, asked["least"].to_numpy()), np.linalg.norm(q, axis=1)
        store, _ = pafs.FileSystem.from_uri(path)
        for file, norm in files[key[1] :: stripes]:
            if not (longest * norm * (1 + 1e-9) + 1e-6 >= best.least).any():
                break
            shard = pq.read_table(pafs.FileSystem.from_uri(file)[1], filesystem=store, columns=["row", "vec_id", "v"])
            search(q, best, shard.column("row").to_numpy(), shard.column("vec_id").to_numpy(), _matrix(shard.column("v"), width), axes)
        sizes = [len(x) for x in best.found]
        return pd.DataFrame({"query_row": np.repeat(rows, sizes), "query_id": np.repeat(asked["vec_id"].to_numpy(), sizes), "vec_id": np.concatenate(best.found), "score": np.concatenate(best.scores)})

    pairs = dealt.groupBy("block", "stripe").applyInPandas(meet, ddl)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH own AS (
  SELECT row_number() OVER () AS at, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.at AS query_at, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product([x::DOUBLE for x in q.v], [x::DOUBLE for x in c.v])::BIGINT AS score
  FROM own q JOIN own c ON c.at <> q.at WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_at ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
