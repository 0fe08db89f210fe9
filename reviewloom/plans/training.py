"""Train, tune, store and evaluate the two linear models on stored splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.evaluation import classification_metrics
from reviewloom.operators.features import TfidfSettings, fit_vocabulary, tfidf_vectors
from reviewloom.operators.linear import long_predictions, vector_margins
from reviewloom.operators.training import (
    C_GRID, Fit, Tuning, coefficient_matrix, intercepts_of, model_table, side_by_side, tune,
)
from reviewloom.sinks.tables import save_models, save_vocabulary
from reviewloom.storage import materialise, scratch_path

KINDS = {"logreg": "logistic", "svm": "squared_hinge"}


@dataclass
class Features:
    """Frozen vocabulary and stored sparse rows of the splits."""

    vocabulary: DataFrame
    n_features: int
    rows: dict[str, DataFrame]


def build_features(
    splits: dict[str, DataFrame],
    settings: TfidfSettings = TfidfSettings(),
    vocabulary_path: str | None = None,
    id_col: str = "id",
    text_col: str = "text_clean_classical",
) -> Features:
    """Fit on ``splits['train']`` only and transform every split once.

    Rows are stored as (id, label, indices, values).
    """
    train = splits["train"]
    path = vocabulary_path or scratch_path(train.sparkSession, "vocabulary")
    vocabulary = save_vocabulary(fit_vocabulary(train, id_col, text_col, settings), path)
    rows, folder = {}, scratch_path(train.sparkSession, "features")
    for name, frame in splits.items():
        # The label travels with the text, so no join is needed afterwards. The folder keeps the name of the
        # split, by which tuning refuses frames it must not see.
        vectors = tfidf_vectors(frame, vocabulary, id_col, text_col, keep=["label"])
        rows[name] = materialise(vectors, "features", f"{folder}/split={name}")
    return Features(vocabulary, vocabulary.count(), rows)


def tune_models(
    features: Features, grid: Sequence[float] = C_GRID, id_col: str = "id", models: Sequence[str] = tuple(KINDS)
) -> dict[str, Tuning]:
    """Tune every model on train and validation rows, side by side; test is not an input."""
    train, validation = features.rows["train"], features.rows["validation"]

    def one(name: str) -> Tuning:
        return tune(train, validation, KINDS[name], features.n_features, grid, id_col)

    return dict(zip(models, side_by_side(train.sparkSession, one, models), strict=True))


def store_models(spark: SparkSession, tuned: dict[str, Tuning], vocabulary: DataFrame, path: str) -> None:
    fits = [_named(t.best, name) for name, t in tuned.items()]
    save_models(model_table(spark, fits, vocabulary), path)


def _named(fit: Fit, name: str) -> Fit:
    return Fit(name, fit.c, fit.weights, fit.intercept, fit.loss, fit.iterations, fit.converged, fit.passes)


def evaluate_models(
    tuned: dict[str, Tuning], rows: DataFrame, id_col: str = "id", by: Sequence[str] = ()
) -> DataFrame:
    """Metrics of the chosen models on held-out rows, all models in one pass.

    ``by`` adds grouping columns of ``rows``, such as the dataset.
    """
    fits = [_named(t.best, name) for name, t in tuned.items()]
    scored = vector_margins(
        rows, coefficient_matrix(fits), intercepts_of(fits), id_col, ["label", *by]
    )
    return classification_metrics(long_predictions(scored, id_col, ["label", *by]), ["model", *by])


def evaluate_on_second_corpus(
    tuned: dict[str, Tuning], features: Features, corpus: DataFrame, id_col: str = "id",
    text_col: str = "text_clean_classical",
) -> DataFrame:
    """Generalisation: the frozen vocabulary and models on another labelled corpus.

    Rows with the placeholder label -1 are left out.
    """
    usable = corpus.where(F.col("label").isin(0, 1))
    rows = tfidf_vectors(usable, features.vocabulary, id_col, text_col, keep=["label"])
    return evaluate_models(tuned, rows, id_col)
