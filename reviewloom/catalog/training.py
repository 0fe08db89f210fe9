"""Fits on the labelled documents. Iterative, so no SQL twin; see the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import labelled
from reviewloom.operators.evaluation import classification_metrics
from reviewloom.operators.training import Problem, calibrate, calibrated_probabilities, fit_linear, model_table
from reviewloom.plans.splits import build_corpus_splits
from reviewloom.plans.training import KINDS, build_features, evaluate_models, tune_models
from reviewloom.sources.corpus import scan_processed
from reviewloom.storage import scratch_path


def _features(spark, sf_dir, names=("train", "validation")):
    """Stored splits of the labelled documents, leaks removed, then features."""
    rows = labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("text_raw"), "label", "split")
    path = scratch_path(spark, "splits")
    build_corpus_splits(rows, "documents", path)
    return build_features({n: scan_processed(spark, path, split=n) for n in names})


def _one_fit(spark, sf_dir, kind):
    features = _features(spark, sf_dir, ("train",))
    fit = fit_linear(features.rows["train"], [Problem("C=1", 1.0)], kind, features.n_features)[0]
    terms = features.vocabulary.select("term", "idf")
    # The intercept has no term.
    return model_table(spark, [fit], features.vocabulary).join(terms, "term", "left").select("term", "idf", "coef")


def grid_results(spark, sf_dir):
    tuned = tune_models(_features(spark, sf_dir))
    frames = [t.grid.withColumn("model", F.lit(name)) for name, t in tuned.items()]
    return frames[0].unionByName(frames[1])


def tuned_test_metrics(spark, sf_dir):
    """Both models tuned on validation, then measured once on test."""
    features = _features(spark, sf_dir, ("train", "validation", "test"))
    return evaluate_models(tune_models(features), features.rows["test"])


def calibrated(spark, sf_dir):
    features = _features(spark, sf_dir)
    model = calibrate(features.rows["train"], 1.0, features.n_features)
    scored = calibrated_probabilities(features.rows["validation"], model, keep=["label"])
    return classification_metrics(scored.withColumn("model", F.lit("svm_calibrated")), ["model"])


QUERIES = {
    "lr_fit": lambda s, d: _one_fit(s, d, KINDS["logreg"]),
    "svm_fit": lambda s, d: _one_fit(s, d, KINDS["svm"]),
    "grid_results": grid_results,
    "tuned_test_metrics": tuned_test_metrics,
    "calibrated": calibrated,
}
ORACLES: dict[str, str] = {}
