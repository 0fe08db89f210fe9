"""Pipeline stages, the guard of the test split, the vocabulary filter, workers without the package."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from reviewloom.operators import features as ft
from reviewloom.operators.lineage import ForbiddenSplit, refuse_split, splits_read
from reviewloom.operators.linear import term_scores
from reviewloom.operators.ml_stages import TermVectorizer, TermVectorizerModel
from reviewloom.operators.training import tune
from reviewloom.plans.training import build_features, tune_models

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def corpus(spark, n=200):
    rng = np.random.default_rng(9)
    words = {1: ["great", "fine", "loved"], 0: ["awful", "dull", "hated"]}
    rows = [(f"r{i}", i % 2, " ".join(rng.choice([*words[i % 2], "film", "plot", "cast"], 10))) for i in range(n)]
    return spark.createDataFrame([*rows, ("empty", 0, ""), ("none", 1, None)], "id string, label int, text_clean_classical string").coalesce(2)


def test_pipeline_round_trip(spark, tmp_path):
    train = corpus(spark)
    settings = {"maxFeatures": 12, "minDf": 3, "maxDf": 0.8}
    pipeline = Pipeline(stages=[TermVectorizer(outputCol="x", **settings), LogisticRegression(featuresCol="x", regParam=0.01, maxIter=10)])
    model = pipeline.fit(train.withColumn("label", F.col("label").cast("double")))
    path = str(tmp_path / "model")
    model.write().save(path)
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    stage = loaded.stages[0]
    assert isinstance(stage, TermVectorizerModel) and stage.uid == model.stages[0].uid
    assert {k: stage.getOrDefault(k) for k in settings} == settings and stage.getOutputCol() == "x"
    columns = ["id", "x", "probability", "prediction"]
    want, got = ([tuple(r) for r in m.transform(train).select(*columns).orderBy("id").collect()] for m in (model, loaded))
    assert got == want and len(got) == 202
    vocabulary = ft.fit_vocabulary(train, "id", "text_clean_classical", ft.TfidfSettings(12, 3, 0.8))
    direct = {r.id: r for r in ft.tfidf_vectors(train, vocabulary, "id", "text_clean_classical").collect()}
    for i, x, *_ in got:
        assert x.size == vocabulary.count() and x.indices.tolist() == direct[i]["indices"] and x.values.tolist() == direct[i]["values"]
    assert Pipeline.load(_saved(pipeline, tmp_path)).getStages()[0].getOrDefault("minDf") == 3


def _saved(pipeline, tmp_path):
    pipeline.write().save(str(tmp_path / "unfitted"))
    return str(tmp_path / "unfitted")


def test_large_vocabularies_take_the_shuffle(spark):
    train = corpus(spark)
    model = TermVectorizer(minDf=1).fit(train)
    keyed = lambda df: {r.id: (r.features.indices.tolist(), r.features.values.round(9).tolist()) for r in df.collect()}
    assert keyed(model._transform(train, 0)) == keyed(model.transform(train))


def test_tuning_refuses_the_test_split(spark, tmp_path):
    rows = corpus(spark)
    path = str(tmp_path / "stored")
    for name in ("train", "validation", "test"):
        rows.withColumn("split", F.lit(name)).write.mode("append").partitionBy("split").parquet(path)
    stored = spark.read.parquet(path)
    assert splits_read(stored) == {"train", "validation", "test"}
    assert splits_read(stored.where("split = 'train'").select("id")) == {"train"}
    assert splits_read(spark.read.parquet(f"{path}/split=test")) == {"test"}
    assert splits_read(stored.where("split <> 'test'").join(stored.where("split = 'test'"), "id")) == {"train", "validation", "test"}
    cached = stored.where("split = 'test'").cache()
    cached.count()
    assert splits_read(cached.where("label = 1")) == {"test"}
    cached.unpersist()
    assert splits_read(rows) == set()
    refuse_split({"train": stored.where("split = 'train'")})
    features = build_features({s: stored.where(F.col("split") == s) for s in ("train", "validation", "test")})
    assert tune_models(features, [1.0], models=["svm"])["svm"].best.converged
    with pytest.raises(ForbiddenSplit, match="validation reads the split 'test'"):
        tune(features.rows["train"], features.rows["test"], "squared_hinge", features.n_features, [1.0])
    with pytest.raises(ForbiddenSplit, match="train reads"):
        tune(features.rows["train"].union(features.rows["test"]), features.rows["validation"], "squared_hinge", features.n_features, [1.0])


def test_filter_keeps_unseen_terms_out_of_the_shuffle(spark):
    train = corpus(spark)
    vocabulary = ft.fit_vocabulary(train, "id", "text_clean_classical")
    names = {r.term for r in vocabulary.collect()}
    unseen = " ".join(f"word{i}" for i in range(500))
    docs = spark.createDataFrame([(1, f"great film {unseen}"), (2, unseen), (3, None)], "id int, t string")
    sent = [(r.id, r.term) for r in ft.candidate_terms(docs, vocabulary, "id", "t").collect()]
    passed = {i: [t for d, t in sent if d == i and t[0] != "\0"] for i in (1, 2, 3)}
    assert sorted(d for d, t in sent if t[0] == "\0") == [1, 2, 3]
    assert set(passed[1]) & names == {"great", "film", "great film"} & names
    # One in some hundred of the unseen terms passes: 16 bits and four hashes for each known one.
    assert len(passed[1]) + len(passed[2]) < 3 + 2 * 1000 * 0.03 and passed[3] == []
    every = [len(r.terms) for r in ft.document_terms(docs, "id", "t").collect()]
    assert sum(every) > 1900
    for most in (0, 1_000_000):
        rows = {r.id: (r["indices"], [round(v, 9) for v in r["values"]]) for r in ft.tfidf_vectors(docs, vocabulary, "id", "t", broadcast_terms=most).collect()}
        first = rows if most == 0 else first  # noqa: F821
        assert rows == first
    coefs = vocabulary.select(F.lit("m").alias("model"), "term", F.lit(1.0).alias("coef"))
    a, b = ({r.id: round(r.margins["m"], 9) for r in term_scores(docs, vocabulary, coefs, {"m": 0.5}, "id", "t", broadcast_terms=n).collect()} for n in (0, 10**6))
    assert a == b and a[3] == 0.5


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Predictions, fits and stages from an empty folder, with nothing on the workers' path."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from reviewloom.session import local_session
spark = local_session(2)
from reviewloom import catalog
q = catalog.queries()
for name in ("predictions", "small_calibrated", "validate_requests"):
    print(name, q[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("\n") >= 3
