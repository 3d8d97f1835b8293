import math

import numpy as np
import pytest

from kelpline.llm import topk
from kelpline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, v double, norm string, shard int, rank int, score long"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 0, 1.0, "n", 2, 3, 4) for i, x in rows], SCHEMA)


def plain(rows, every=50, k=5):
    own = []
    for i, x in rows:
        if i is None or x is None or any(e is None or not math.isfinite(e) for e in x):
            continue
        own.append((i, [math.floor(256 * float(np.float32(e))) for e in x]))
    out = []
    for at, (q, a) in enumerate(own):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(own) if n != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in topk.top_k(df, **options).select("query_id", "rank", "vec_id", "score").collect())


def test_sql(agrees):
    agrees(QUERIES["op8_exact_top_k"], ORACLE_SQL["op8_exact_top_k"])


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    for name, small in (("SEEDS", 7), ("BLOCK", 16), ("AXES", 3), ("SHARD_BYTES", 8 * 8 * 100), ("QUERY_BYTES", 8 * 8 * 3)):
        monkeypatch.setattr(topk, name, small)
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.standard_normal(8) * rng.lognormal(0, 1.5)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(120)]  # ties: one vector many times
    assert got(table(spark, rows)) == plain(rows)


def test_repeated_ids_stay_apart(spark, tmp_path):
    """The query and its SQL agree on a table whose ids repeat."""
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(int(i) // 3, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(600)] + [(1, [3.0] * 4), (1, [2.0] * 4), (50, None)]
    df = table(spark, rows)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ours = sorted(tuple(r) for r in QUERIES["op8_exact_top_k"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert ours == sorted(tuple(r) for r in duck.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op8_exact_top_k']})").fetchall()) == plain(rows)


def test_vectors_without_components(spark):
    rows = [(50, []), (1, []), (2, []), (3, None)]
    assert got(table(spark, rows)) == [(50, 1, 1, 0), (50, 2, 2, 0)]


def test_corpus_is_dealt_once(spark, monkeypatch):
    """However many blocks of queries, each vector is in one shard, and shards fall in length."""
    monkeypatch.setattr(topk, "SHARD_BYTES", 8 * 4 * 50)
    rng = np.random.default_rng(1)
    own = topk.materialise(topk.prepared(table(spark, [(i, rng.standard_normal(4).tolist()) for i in range(1000)] + [(7, [1.0] * 4)] * 500)))
    path, files = topk.written_by_length(own, 30)
    assert spark.read.parquet(path).count() == 1500 and len(files) > 15
    assert [n for _, n in files] == sorted((n for _, n in files), reverse=True)
    sizes = [spark.read.parquet(f).count() for f, _ in files]
    assert max(sizes) < 300  # a length that a third of the rows have is dealt over shards too


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [9.0, 9.0]), (6, [-1.0, 3.0]), (7, [-1.0, 3.0]), (50, [0.0, 0.0]), (8, [])]
    assert got(table(spark, rows)) == plain(rows)


def test_values_beyond_exact_doubles():
    q, c = np.array([[2.0**30, 1.0]]), np.array([[2.0**31 + 1, 3.0]])
    assert topk.products(q, c).tolist() == [[2**30 * (2**31 + 1) + 3]]
    assert topk.products(np.array([[2.0**60]]), np.array([[2.0**60]])).tolist() == [[2**63 - 1]]


def test_empty(spark):
    assert got(table(spark, [])) == [] and got(table(spark, [(1, [1.0])])) == [] and got(table(spark, [(50, [1.0])])) == []
