"""Co-trained quality and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from clipweave.llm import quality
from clipweave.llm.common import clear_scratch
from clipweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_clean_documents_stay_and_junk_goes(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op8_cotrained_quality"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    kept = [r["accepted"] for r in rows if labels.get(r["doc_id"]) == 1]
    junk = [r["accepted"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(kept) >= 0.99 and np.mean(junk) <= 0.1


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = labels.where("doc_id % 4 = 1")
    verdicts = quality.classify(docs, labels.where("doc_id % 4 <> 1")).join(test, "doc_id").collect()
    right = [r["accepted"] == (r["quality"] == 1) for r in verdicts]
    assert len(right) > 800 and np.mean(right) >= 0.97
    assert np.mean([r["accepted"] for r in verdicts if r["quality"] == 1]) >= 0.99


def test_views_teach_each_other_only_with_proof():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(int)
    good = (y * 2 - 1)[:, None] * np.ones((400, 3), np.float32) + rng.normal(0, 0.4, (400, 3)).astype(np.float32)
    noise = rng.normal(size=(400, 3)).astype(np.float32)
    truth = (rng.random(500) < 0.5).astype(int)
    pool = [(truth * 2 - 1)[:, None] * np.ones((500, 3), np.float32), rng.normal(size=(500, 3)).astype(np.float32)]
    model = quality.CoTrained([good, noise], y, pool, 3, 50, 0.95)
    assert model.given[0] > 0 and model.given[1] == 0
    assert ((model.score(pool) > 0.5) == truth).mean() > 0.97


def test_quality_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("x"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None, "x"), (10**6 + 1, " \n", "en", "s", -4, "x"),
                                 (10**6 + 2, "the of and " * 60000, None, None, None, "x")] * 2, docs.schema)
    found = quality.classify(docs.union(odd), labels)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == docs.count() + 6
    assert rows[10**6]["score"] == 0 and not rows[10**6 + 1]["accepted"]
    assert quality.classify(docs.limit(0), labels).count() == 0
    bare = quality.classify(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(bare) == (0.5, 0.5)


def test_stages_work_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == [
        "quality classifier", "language ID", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 %", None, "s", 4)], docs.schema)
    step, seen = docs.union(odd), None
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, step, SF).cache()
        assert out.columns == columns
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids and (seen is None or ids <= seen)
        assert not ids & {10**6, 10**6 + 1} and (name == "quality classifier" or 10**6 + 2 not in ids)
        step, seen = out, ids
    packed = pipeline.STAGES[-1][1](spark, step, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == seen
    assert pipeline.STAGES[-1][1](spark, step.limit(0), SF).count() == 0
    clear_scratch(spark)


def test_near_duplicates_keep_one_of_each_group(spark):
    from tests.llm.test_minhash import brute

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {i for i, (_, _, kept) in brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5).items() if kept}
    assert {r["doc_id"] for r in pipeline.dedup_stage(spark, docs, "").collect()} == want


def test_repeated_and_null_ids_are_learned_once(spark, monkeypatch):
    """One unlabelled id holds most rows, others have no id: each id reaches the driver once."""
    seen = {}

    class Spy(quality.CoTrained):
        def __init__(self, views, y, pools, *rest):
            seen["labelled"], seen["pool"] = len(y), len(pools[0])
            super().__init__(views, y, pools, *rest)

    monkeypatch.setattr(quality, "CoTrained", Spy)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    more = [(10**6, f"text number {i % 3}", "s", "en", 9) for i in range(400)] + [(None, "no id", "s", "en", 5)] * 100
    every = docs.union(spark.createDataFrame(more, docs.schema))
    out = quality.classify(every, labels)
    assert out.count() == docs.count() + 500
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct().count()
    assert seen == {"labelled": known, "pool": docs.select("doc_id").distinct().count() - known + 1}


def test_scores_are_those_of_the_weights(spark, monkeypatch):
    """Scores of all documents again, one by one, from the trained weights and the plain features."""
    made = []

    class Spy(quality.CoTrained):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(quality, "CoTrained", Spy)
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_cotrained_quality"](spark, sf).collect()
    (model,) = made
    import pyarrow as pa

    for r in rows:
        d = docs[r["doc_id"]]
        views = [quality.text_view(pa.array([d["text"]])), quality.meta_view([d["source"]], [d["lang"]], [d["n_chars"]])]
        logit = [model.calibration[k][0] * (float(views[k][0] @ model.weights[k][0]) + model.weights[k][1]) + model.calibration[k][1] for k in (0, 1)]
        z = sum(w * min(30, max(-30, x)) for w, x in zip(model.combined[0], logit)) + model.combined[1]
        want = 0.0 if not (d["text"] or "").strip() else 1 / (1 + np.exp(-z))
        assert abs(r["score"] - want) < 1e-4
