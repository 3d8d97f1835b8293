import zlib

import numpy as np
import pytest

from kelpline.llm import quality
from kelpline.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, text string, source string"


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[k % 8]}{k}ly" for k in rng.integers(0, 3000, int(rng.integers(5, 200)))]
        good = i % 4 > 0
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words), f"s{i % 3}"))
        labels.append((i, int(good), 0, "x", "y"))
    return rows, labels


def test_isotonic_against_definition():
    n, y = np.array([1.0, 2, 1, 4]), np.array([1.0, 0, 1, 2])
    fit = quality.isotonic(n, y)
    assert (np.diff(fit) >= 0).all() and fit @ n == pytest.approx(y.sum())
    assert fit.tolist() == pytest.approx([1 / 3, 1 / 3, 3 / 5, 3 / 5])


def test_learns_held_out(documents, spark):
    rows, labels = corpus(400)
    out = quality.classify(documents(rows), spark.createDataFrame(labels, LABELS)).toPandas()
    held = out[out.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True))
    assert ((held.predicted == 1) == (held.doc_id % 4 > 0)).mean() > 0.97
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_held_out_labels_are_not_used(documents, spark):
    rows, labels = corpus(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, x, s) for i, q, t, x, s in labels]
    a, b = (quality.classify(documents(rows), spark.createDataFrame(x, LABELS)).toPandas().sort_values("doc_id") for x in (labels, turned))
    assert np.allclose(a.score, b.score)


def test_odd_rows(documents, odd_rows, spark):
    rows, labels = corpus(60)
    both = [(None if i is None else i + 1000, t, s) for i, t, s in odd_rows] + rows
    odd_labels = [*labels, (1001, None, 0, "", ""), (None, 1, 0, "", ""), (1, 1, 0, "", "")]
    out = quality.classify(documents(both), spark.createDataFrame(odd_labels, LABELS)).toPandas()
    assert len(out) == len(both) and out.score.notna().all()
    same = out[out.doc_id.isin([1001, 1002])].score
    assert same.nunique() == 1


def test_without_labels_or_documents(documents, spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(documents([]), none).count() == 0
    assert quality.classify(documents([(1, "a", "s")]), none).first()["score"] == 0.5
    one = spark.createDataFrame([(1, 0, 0, "", ""), (2, 0, 0, "", ""), (3, 0, 0, "", "")], LABELS)
    assert quality.classify(documents([(1, "a", "s"), (2, "b", "s"), (3, "c", "s")]), one).toPandas().predicted.sum() == 0


def test_held_out_accuracy_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = QUERIES["op3_quality_classifier"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.95
