import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from kelpline.llm import packing
from kelpline.llm.common import BATCH_BYTES, BATCH_ROWS
from kelpline.llm.queries import QUERIES, tokenizer_path


def test_stages_keep_the_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = pipeline.materialise(stage(spark, docs, sf_dir))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = {r["doc_id"] for r in out.collect()}
        if name == "quality_classifier":
            good = {i for i in before if labels.get(i) == 1}
            assert len(good & kept) >= 0.97 * len(good) and kept < before
            texts = {r["text"] for r in out.collect()}
        if name == "simhash_near_dedup":
            assert {r["text"].lower() for r in out.collect()} <= {t.lower() for t in texts} and out.count() == out.select("text").distinct().count()
        if name == "secret_scans":
            assert out.count() == docs.count()
        docs = out if name != pipeline.STAGES[-1][0] else docs
    mixed = docs.toPandas()
    pieces = out.toPandas()
    encode = packing.encoder(tokenizer_path())
    assert pieces.length.sum() == sum(len(encode(t)) + 1 for t in mixed.text)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]]


def test_each_row_is_judged_by_its_own_text(spark, sf_dir, documents):
    """Rows that share a doc_id, or have none, are judged apart; a column named like one of the stage's own is kept."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op3_quality_classifier"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    good, bad = next(texts[i] for i in texts if scores[i] == 1), next(texts[i] for i in texts if scores[i] == 0)
    clash = documents([(-1, good, "s"), (-1, bad, "s"), (None, good, "s"), (None, bad, "s")]).withColumn("rejected", pipeline.quality.F.lit(1))
    out = pipeline.drop_low_quality(spark, own.select("doc_id", "text").unionByName(clash, allowMissingColumns=True), sf_dir)
    kept = [(r["doc_id"], r["text"]) for r in out.where("rejected = 1").collect()]
    assert sorted(kept, key=str) == sorted([(-1, good), (None, good)], key=str) and "rejected" in out.columns


def test_stages_survive_odd_documents(spark, sf_dir, documents, odd_rows):
    for name, stage in pipeline.STAGES:
        out = stage(spark, documents(odd_rows), sf_dir)
        rows = [r["doc_id"] for r in out.collect()]
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == documents([]).columns
        if name == "simhash_near_dedup":
            assert len(rows) == 6  # two texts of six words or more, those of one word, none, and the row without an id
        if name == "secret_scans":
            assert len(rows) == len(odd_rows)
        if name == "best_fit_packing":
            assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in out.collect()}) == len(rows) >= len(odd_rows)
        assert stage(spark, documents([]), sf_dir).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_python_gets_small_batches(spark, sf_dir):
    """Stages with Python workers bound their Arrow batches by rows and by bytes, and keep smaller limits."""
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})

    try:
        docs = spark.createDataFrame([(1, "a word", "a", 6)], "doc_id long, text string, source string, n_chars long")
        assert pipeline.pack_sequences(spark, docs, sf_dir).count() == 1
        for n, length in ((9000, 10), (1500, 20_000)):
            seen = spark.range(0, n, 1, 1).selectExpr(f"repeat('x', {length}) AS text").mapInArrow(sizes, "n long, b long").collect()
            assert sum(r["n"] for r in seen) == n
            assert max(r["n"] for r in seen) <= BATCH_ROWS and max(r["b"] for r in seen) <= 2 * BATCH_BYTES
        spark.conf.set(keys[0], "7")
        pipeline.pack_sequences(spark, docs, sf_dir)
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
