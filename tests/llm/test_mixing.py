import re

import pytest

from kelpline.llm import mixing
from kelpline.llm.queries import ORACLE_SQL, QUERIES


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        each, over = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += each * weight[s]
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return target


def test_sql(agrees):
    agrees(QUERIES["op5_mixing_sources"], ORACLE_SQL["op5_mixing_sources"])


def check(rows, out):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    targets = plain_targets(sizes)
    assert len(out) == len(rows)
    taken = {}
    by_id = {i: s for i, _, s in rows}
    for r in out.itertuples():
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id == r.doc_id:
            s = by_id[int(r.doc_id)]
            taken[s] = taken.get(s, 0) + r.taken
            assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
    return targets, taken


def test_odd_rows(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    targets, taken = check(rows, mixing.mix(documents(rows)).toPandas())
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert len(mixing.mix(documents(odd_rows)).toPandas()) == len(odd_rows)


def test_many_sources(documents):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 11}" if i % 3 else "hot") for i in range(900)]
    a, b = (mixing.mix(documents(rows)).toPandas() for _ in range(2))
    targets, taken = check(rows, a)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert a.equals(b) and a.position.is_monotonic_increasing


def test_apply_repeats_whole_documents(documents):
    rows = [(i, "w " * 20, "small" if i % 10 == 0 else "large") for i in range(400)] + [(1000, "", "small"), (1001, None, "large")]
    docs = documents(rows)
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    got = out.toPandas()
    words = got.text.map(size_of).groupby(got.source).sum()
    sizes = {"small": 800, "large": 7200}
    assert all(abs(words[s] - t) <= 20 for s, t in plain_targets(sizes).items())
    assert got.groupby("doc_id").size().max() == 2 and (got.doc_id == 1001).sum() == 1


def test_empty(documents):
    assert mixing.mix(documents([])).count() == 0 and mixing.apply(documents([])).count() == 0
    assert mixing.mix(documents([(1, None, None)])).first()["target"] == 0.0


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    rows = [(u / 10, a) for u in range(11) for a in (0.5, 0.0, -0.5)]
    for u, a, t in spark.createDataFrame(rows, "u double, a double").select("u", "a", mixing.position(F.col("u"), F.col("a"))).collect():
        assert t * (1 - a) + a * t * t == pytest.approx(u)
