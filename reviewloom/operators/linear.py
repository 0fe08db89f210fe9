"""Linear models over TF-IDF features: scores, labels, probabilities.

A model is rows (model, term, coef) plus an intercept per model. All models
of a table are scored in the same pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from reviewloom.functions.scoring import label_name, sigmoid
from reviewloom.operators.features import BROADCAST_TERMS, known_terms, map_rows, term_table


def term_scores(
    df: DataFrame,
    vocabulary: DataFrame,
    coefficients: DataFrame,
    intercepts: dict[str, float],
    id_col: str,
    text_col: str,
    keep: Sequence[str] = (),
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(id, *keep, margins MAP<model, DOUBLE>), a row for every row of ``df``.

    ``coefficients``: (model, term, coef). Map-only while the vocabulary (counted) fits in a
    task. Dot product and norm are two sums of the same pass, so no vector is built.
    """
    models, bias = list(intercepts), list(intercepts.values())
    columns = [f"c{i}" for i in range(len(models))]
    per_term = coefficients.groupBy("term").agg(
        *[F.sum(F.when(F.col("model") == m, F.col("coef"))).alias(c) for c, m in zip(columns, models, strict=True)]
    )
    weighted = vocabulary.select("term", "idx", "idf").join(per_term, "term", "left")
    table = term_table(weighted, columns, broadcast_terms)
    if table is not None:

        def margins(n, row, place, weight, held):
            norm = np.sqrt(np.bincount(row, weight * weight, n))
            norm[norm == 0] = 1.0
            return [margin_maps(models, [np.bincount(row, weight * c[place], n) / norm + b for c, b in zip(held.extra, bias, strict=True)])]

        return map_rows(df, table, id_col, text_col, keep, margins, "margins map<string,double>")
    sums = (
        known_terms(df, weighted, id_col, text_col, keep)
        .groupBy("__row", id_col, *keep)
        .agg(
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
            *[F.sum(F.col("w") * F.col(c)).alias(f"d{c}") for c in columns],
        )
    )
    entries = []
    for c, m, b in zip(columns, models, bias, strict=True):
        dot = F.coalesce(F.try_divide(F.col(f"d{c}"), F.col("norm")), F.lit(0.0))
        entries += [F.lit(m), dot + F.lit(float(b))]
    return sums.select(id_col, *keep, F.create_map(*entries).alias("margins"))


def vector_margins(
    rows: DataFrame, coefficients: np.ndarray, intercepts: dict[str, float], id_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, *keep, margins MAP) from stored sparse rows (indices, values), without a shuffle.

    ``coefficients``: [terms, models], models in the order of ``intercepts``. The matrix
    of a fit goes to the tasks as one broadcast variable; it has a row for each vocabulary term.
    """
    models, bias = list(intercepts), list(intercepts.values())
    kept = list(dict.fromkeys([id_col, *keep]))
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(coefficients.T))

    def work(batches):
        weights = shared.value
        for batch in batches:
            lengths = np.nan_to_num(pc.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False)).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            idx, val = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
            sums = [np.bincount(row, val * w[idx], batch.num_rows) + b for w, b in zip(weights, bias, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], margin_maps(models, sums)], names=[*kept, "margins"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "indices", "values").mapInArrow(work, f"{fields}, margins map<string,double>")


def margin_maps(models: Sequence[str], sums: Sequence[np.ndarray]) -> pa.MapArray:
    n = len(sums[0])
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(models))
    return pa.MapArray.from_arrays(offsets, pa.array(list(models) * n, pa.string()), pa.array(np.stack(sums, axis=1).ravel()))


def predicted_label(margin: Column) -> Column:
    return F.when(margin > 0, 1).otherwise(0)


def long_predictions(scored: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, model, margin, pred): one row per model."""
    return scored.select(id_col, *keep, F.explode("margins").alias("model", "margin")).withColumn(
        "pred", predicted_label(F.col("margin"))
    )


def margin_to_prediction(df: DataFrame, margin: Column, tag: Column) -> DataFrame:
    """Add pred, sentiment, confidence of the predicted class (four decimals) and model tag."""
    pred = predicted_label(margin)
    positive = sigmoid(margin)
    return (
        df.withColumn("pred", pred)
        .withColumn("sentiment", label_name(pred))
        .withColumn("confidence", F.round(F.when(pred == 1, positive).otherwise(1 - positive), 4))
        .withColumn("model", tag)
    )


def dispatch(
    df: DataFrame,
    model_col: str,
    tags: dict[str, str],
    vocabulary: DataFrame,
    coefficients: DataFrame,
    intercepts: dict[str, float],
    id_col: str,
    text_col: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score every row with the model it names, in one pass for all models.

    Returns (id, *keep, sentiment, confidence, model). Rows naming an unknown model are
    not scored; validation reports them.
    """
    named = df.where(F.col(model_col).isin(*intercepts)).withColumn("__requested", F.col(model_col))
    scored = term_scores(
        named, vocabulary, coefficients, intercepts, id_col, text_col, ["__requested", *keep]
    )
    tag = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    margin = F.element_at("margins", F.col("__requested"))
    return margin_to_prediction(scored, margin, F.element_at(tag, F.col("__requested"))).select(
        id_col, *keep, "sentiment", "confidence", "model"
    )


def batch_scores(
    df: DataFrame,
    input_cols: Sequence[str],
    make_predict: Callable,
    batch_size: int = 32,
    input_shapes: Sequence[Sequence[int] | None] | None = None,
    output_col: str = "logits",
) -> DataFrame:
    """Add the logits of a user's model, evaluated in batches.

    ``make_predict`` loads the model once per Python worker and returns a
    function from numpy arrays to a numpy array (rows, classes).
    ``input_shapes`` gives the row shape of each array column.
    """
    udf = predict_batch_udf(
        make_predict,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    return df.withColumn(output_col, udf(*input_cols))
