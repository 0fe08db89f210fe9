"""Scores, predictions and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reviewloom.catalog.inputs import (
    HASH_INTERCEPTS, HASH_MODELS, SQL_LABELLED, cleaned, documents, hash_coefficients, labelled,
    sql_classical, sql_margins, sql_vocabulary, sql_weights, stored_vocabulary, table,
)
from reviewloom.functions.scoring import display_percent, logits_to_prediction
from reviewloom.operators.evaluation import best_setting, classification_metrics, confusion_counts
from reviewloom.operators.linear import (
    batch_scores, dispatch, long_predictions, margin_to_prediction, term_scores,
)
from reviewloom.operators.ranking import timing_statistics
from reviewloom.operators.requests import MODEL_TAGS
from reviewloom.operators.training import C_GRID

OFFSET_STEP = 0.05


def score_documents(spark, sf_dir, rows, keep=()):
    """Margins of the hash models for (doc_id, text, *keep)."""
    vocabulary = stored_vocabulary(spark, sf_dir)
    return term_scores(
        cleaned(rows), vocabulary, hash_coefficients(vocabulary), HASH_INTERCEPTS, "doc_id", "clean",
        keep,
    )


def linear_scores(spark, sf_dir):
    docs = documents(spark, sf_dir).where("split = 'test'").select("doc_id", "text")
    return long_predictions(score_documents(spark, sf_dir, docs), "doc_id").select(
        "doc_id", "model", F.round("margin", 6).alias("margin")
    )


def predictions(spark, sf_dir):
    docs = documents(spark, sf_dir).where("split = 'test'").select("doc_id", "text")
    scored = score_documents(spark, sf_dir, docs).select("doc_id", F.col("margins")["logreg"].alias("m"))
    return margin_to_prediction(scored, F.col("m"), F.lit(MODEL_TAGS["logreg"])).select(
        "doc_id", "pred", "sentiment", "confidence", display_percent(F.col("confidence")).alias("percent"), "model"
    )


def softmax_predictions(spark, sf_dir):
    logits = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("logits")
    )
    return logits_to_prediction(logits, "logits", MODEL_TAGS["distilbert"]).select(
        "vec_id", "pred", "sentiment", "confidence", "model"
    )


def dispatch_predictions(spark, sf_dir):
    even = F.substring(F.md5(F.concat(F.lit("model:"), F.col("doc_id").cast("string"))), 1, 1) < "8"
    rows = cleaned(documents(spark, sf_dir).select("doc_id", "text")).withColumn(
        "requested", F.when(even, HASH_MODELS[0]).otherwise(HASH_MODELS[1])
    )
    vocabulary = stored_vocabulary(spark, sf_dir)
    return dispatch(
        rows, "requested", MODEL_TAGS, vocabulary, hash_coefficients(vocabulary), HASH_INTERCEPTS,
        "doc_id", "clean",
    )


def _two_sums():
    def predict(vectors: np.ndarray) -> np.ndarray:
        wide = vectors.astype(np.float64)
        half = wide.shape[1] // 2
        return np.stack([wide[:, :half].sum(axis=1), wide[:, half:].sum(axis=1)], axis=1)

    return predict


def batch_udf_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    least, width = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != width:
        raise ValueError(f"vectors have between {least} and {width} entries; the model takes one width")
    width = width or 2
    return batch_scores(vectors, ["v"], _two_sums, input_shapes=[[width]]).select(
        "vec_id", F.round(F.col("logits")[0], 5).alias("logit_0"), F.round(F.col("logits")[1], 5).alias("logit_1")
    )


def _evaluated(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label", "lang")
    return long_predictions(score_documents(spark, sf_dir, rows, ["label", "lang"]), "doc_id", ["label", "lang"])


def confusion_matrix(spark, sf_dir):
    return confusion_counts(_evaluated(spark, sf_dir), ["model"])


def metrics(spark, sf_dir):
    return classification_metrics(_evaluated(spark, sf_dir), ["model"]).withColumn(
        "confusion_matrix", F.col("confusion_matrix").cast("string")
    )


def generalisation_by_lang(spark, sf_dir):
    return classification_metrics(_evaluated(spark, sf_dir), ["model", "lang"]).drop("confusion_matrix")


def best_c(spark, sf_dir):
    """Each grid entry shifts the decision of one model; the best F1 is chosen."""
    grid = F.array(
        *[F.struct(F.lit(i).alias("grid_pos"), F.lit(c).alias("C")) for i, c in enumerate(C_GRID)]
    )
    scored = _evaluated(spark, sf_dir).where("model = 'logreg'").select("label", "margin", F.inline(grid))
    shifted = scored.withColumn(
        "pred", F.when(F.col("margin") > (F.col("grid_pos") - 3) * OFFSET_STEP, 1).otherwise(0)
    )
    return best_setting(classification_metrics(shifted, ["grid_pos", "C"])).drop("confusion_matrix")


def latency_stats(spark, sf_dir):
    return timing_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")


QUERIES = {
    "linear_scores": linear_scores,
    "predictions": predictions,
    "softmax_predictions": softmax_predictions,
    "dispatch_predictions": dispatch_predictions,
    "batch_udf_scores": batch_udf_scores,
    "confusion_matrix": confusion_matrix,
    "classification_metrics": metrics,
    "generalisation_by_lang": generalisation_by_lang,
    "best_c": best_c,
    "latency_stats": latency_stats,
}


def sql_scored(source_sql: str) -> str:
    """CTEs ending in s_m (doc_id, model, margin) for the rows of ``source_sql``."""
    return f"""{sql_vocabulary()}, s AS ({source_sql}),
    s_clean AS (SELECT doc_id, {sql_classical('text')} AS clean FROM s),
    {sql_weights('s', 's_clean', 'doc_id', 'clean')}, {sql_margins('s', 's', 'doc_id')}"""


def sql_prediction(margin: str) -> str:
    return f"""CASE WHEN {margin} > 0 THEN 'positive' ELSE 'negative' END AS sentiment,
        round(CASE WHEN {margin} > 0 THEN 1 / (1 + exp(-{margin})) ELSE 1 - 1 / (1 + exp(-{margin})) END, 4)
        AS confidence"""


SQL_METRICS = """round(coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0), 4) AS accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision",
    round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"""
SQL_COUNTS = """CAST(count_if(label = 0 AND pred = 0) AS BIGINT) AS tn,
    CAST(count_if(label = 0 AND pred = 1) AS BIGINT) AS fp,
    CAST(count_if(label = 1 AND pred = 0) AS BIGINT) AS fn,
    CAST(count_if(label = 1 AND pred = 1) AS BIGINT) AS tp"""
_TEST = "SELECT doc_id, text FROM docs WHERE split = 'test'"
SQL_EVALUATED = f"""{sql_scored('SELECT * FROM documents JOIN labels USING (doc_id)')},
    p AS (SELECT s.doc_id, s.lang, s.quality AS label, model, margin, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS pred
          FROM s_m JOIN s USING (doc_id))"""

ORACLES = {
    "linear_scores": f"WITH {sql_scored(_TEST)} SELECT doc_id, model, round(margin, 6) AS margin FROM s_m",
    "predictions": f"""WITH {sql_scored(_TEST)}, q AS (SELECT doc_id, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS pred,
        {sql_prediction('margin')}, 'tfidf-logreg-v1.0' AS model FROM s_m WHERE model = 'logreg')
        SELECT *, round(confidence * 1000) / 10 AS percent FROM q""",
    "softmax_predictions": """WITH l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a,
        CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)
        SELECT vec_id, CASE WHEN b > a THEN 1 ELSE 0 END AS pred,
        CASE WHEN b > a THEN 'positive' ELSE 'negative' END AS sentiment,
        round(exp(greatest(a, b)) / (exp(a) + exp(b)), 4) AS confidence, 'distilbert-onnx-int8' AS model FROM l""",
    "dispatch_predictions": f"""WITH {sql_scored('SELECT doc_id, text FROM documents')}
        SELECT doc_id, {sql_prediction('margin')},
        CASE model WHEN 'logreg' THEN 'tfidf-logreg-v1.0' ELSE 'distilbert-onnx-int8' END AS model
        FROM s_m WHERE model = CASE WHEN substr(md5('model:' || doc_id), 1, 1) < '8'
        THEN 'logreg' ELSE 'distilbert' END""",
    "batch_udf_scores": """SELECT vec_id,
        round(list_sum(CAST(embedding[1:len(embedding) // 2] AS DOUBLE[])), 5) AS logit_0,
        round(list_sum(CAST(embedding[len(embedding) // 2 + 1:] AS DOUBLE[])), 5) AS logit_1 FROM embeddings""",
    "confusion_matrix": f"WITH {SQL_EVALUATED} SELECT model, {SQL_COUNTS} FROM p GROUP BY model",
    "classification_metrics": f"""WITH {SQL_EVALUATED}, c AS (SELECT model, {SQL_COUNTS} FROM p GROUP BY model)
        SELECT model, {SQL_METRICS}, '[[' || tn || ', ' || fp || '], [' || fn || ', ' || tp || ']]'
        AS confusion_matrix FROM c""",
    "generalisation_by_lang": f"""WITH {SQL_EVALUATED}, c AS (SELECT model, lang, {SQL_COUNTS} FROM p
        GROUP BY model, lang) SELECT model, lang, {SQL_METRICS} FROM c""",
    "best_c": f"""WITH {SQL_EVALUATED}, grid(grid_pos, "C") AS
        (VALUES {', '.join(f'({i}, CAST({c} AS DOUBLE))' for i, c in enumerate(C_GRID))}),
        g AS (SELECT grid_pos, "C", label, CASE WHEN margin > (grid_pos - 3) * {OFFSET_STEP} THEN 1 ELSE 0 END
        AS pred FROM p, grid WHERE model = 'logreg'),
        c AS (SELECT grid_pos, "C", {SQL_COUNTS} FROM g GROUP BY grid_pos, "C")
        SELECT grid_pos, "C", {SQL_METRICS} FROM c ORDER BY f1 DESC, grid_pos LIMIT 1""",
    "latency_stats": """WITH o AS (SELECT event_type, value,
        row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS n_measured, round(avg(value), 3) AS mean_ms,
        round(median(value), 3) AS median_ms,
        round(max(value) FILTER (k = least(n * 95 // 100, n - 1)), 3) AS p95_ms,
        round(min(value), 3) AS min_ms, round(max(value), 3) AS max_ms FROM o GROUP BY event_type""",
}
