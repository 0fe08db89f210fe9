"""Validation and scoring of JSON requests, for tables and micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.cleaning import clean_for_classical, exceeds_length, is_blank
from reviewloom.functions.scoring import epoch_seconds, logits_to_prediction
from reviewloom.operators.linear import batch_scores, margin_to_prediction, term_scores

# Names and tags of the two models, the default, and the limit.
MODEL_TAGS = {"logreg": "tfidf-logreg-v1.0", "distilbert": "distilbert-onnx-int8"}
DEFAULT_MODEL = "logreg"
MAX_TEXT_LENGTH = 5000

# Error codes and messages of the request contract.
ERRORS = {
    "method": (405, "method_not_allowed", "Only POST is supported."),
    "no_body": (400, "invalid_request", "Request body is required."),
    "not_json": (400, "invalid_request", "Request body must be valid JSON."),
    "not_object": (500, "internal_error", "An internal error occurred."),
    "no_text": (422, "validation_error", "The 'text' field is required."),
    "text_type": (422, "validation_error", "The 'text' field must be a string."),
    "blank": (422, "validation_error", "The 'text' field cannot be empty or whitespace-only."),
    "too_long": (422, "validation_error", "The 'text' field exceeds the maximum length of {limit} characters."),
    "model": (422, "validation_error", "The 'model' field must be one of {models}."),
}


_FIELDS = ("top", "text_type", "text", "model_type", "model")


@F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in _FIELDS]))
def _lenient(bodies: pa.Array) -> pa.Array:
    """Bodies the strict parser refuses: a repeated key takes its last value, NaN and Infinity are numbers."""

    def kind(value):
        if isinstance(value, str):
            return "STRING"
        return "VOID" if value is None else "OTHER"

    rows = []
    for body in bodies.to_pylist():
        row = None
        if body is not None:
            try:
                value = json.loads(body)
            except (ValueError, RecursionError):
                value = rows  # no JSON value is this list itself
            if value is not rows:
                row = {"top": "OBJECT" if isinstance(value, dict) else "OTHER"}
                for name in ("text", "model"):
                    if isinstance(value, dict) and name in value:
                        row |= {f"{name}_type": kind(value[name]), name: value[name] if isinstance(value[name], str) else None}
        rows.append(row)
    return pa.array(rows, pa.struct([(name, pa.string()) for name in _FIELDS]))


def validate_requests(
    df: DataFrame, models: Sequence[str] = tuple(MODEL_TAGS), max_length: int = MAX_TEXT_LENGTH
) -> DataFrame:
    """Add status, error, message, text and requested model to (method, body, ...).

    The first broken rule wins; a valid request has status 200. Works on batch
    and streaming frames alike.
    """
    strict = F.try_parse_json("body")
    # Only bodies that may be JSON for a more lenient parser reach it, the others as nulls: those with a
    # repeated key, or with a number word. Its node sees every row, but takes the text of these alone.
    again = F.col("body").isNotNull() & F.col("__json").isNull() & F.col("body").rlike(r"^[ \t\r\n]*([\[{]|NaN|-?Infinity)")
    parsed = (
        df.withColumn("__json", strict)
        .withColumn("__text", F.try_variant_get("__json", "$.text", "variant"))
        .withColumn("__model", F.try_variant_get("__json", "$.model", "variant"))
        .withColumn("__more", _lenient(F.when(again, F.col("body"))))
        .withColumn("__top", F.when(F.col("__json").isNull(), F.col("__more.top")).when(F.col("body").rlike(r"^[ \t\r\n]*\{"), "OBJECT").otherwise("OTHER"))
        .withColumn("__text_type", F.coalesce(F.schema_of_variant("__text"), "__more.text_type"))
        .withColumn("__model_type", F.coalesce(F.schema_of_variant("__model"), "__more.model_type"))
        .withColumn("text", F.coalesce(F.try_variant_get("__json", "$.text", "string"), "__more.text"))
        .withColumn("requested", F.coalesce(F.try_variant_get("__json", "$.model", "string"), "__more.model"))
    )
    text, model_type = F.col("text"), F.col("__model_type")
    unknown_model = model_type.isNotNull() & (
        (model_type != "STRING") | ~F.coalesce(F.col("requested").isin(*models), F.lit(False))
    )
    rules = [
        ("method", F.col("method").isNotNull() & (F.col("method") != "") & (F.col("method") != "POST")),
        ("no_body", F.col("body").isNull()),
        ("not_json", F.col("__top").isNull()),
        ("not_object", F.col("__top") != "OBJECT"),
        ("no_text", F.col("__text_type").isNull() | (F.col("__text_type") == "VOID")),
        ("text_type", F.col("__text_type") != "STRING"),
        ("blank", is_blank(text)),
        ("too_long", exceeds_length(text, max_length)),
        ("model", unknown_model),
    ]
    outcome = None
    for name, broken in rules:
        status, error, message = ERRORS[name]
        message = message.replace("{limit}", str(max_length)).replace("{models}", str(sorted(models)))
        value = F.struct(F.lit(status).alias("status"), F.lit(error).alias("error"), F.lit(message).alias("message"))
        outcome = F.when(broken, value) if outcome is None else outcome.when(broken, value)
    valid = F.struct(
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("message"),
    )
    checked = parsed.withColumn("__outcome", outcome.otherwise(valid))
    ok = F.col("__outcome.status") == 200
    row = F.struct(
        "__outcome.status",
        "__outcome.error",
        "__outcome.message",
        F.when(ok, text).alias("text"),
        F.when(ok, F.coalesce("requested", F.lit(DEFAULT_MODEL))).alias("requested"),
    )
    # As a one-row generator the outcome is computed once: filters on it stay
    # above and do not repeat the parsing.
    return checked.select(*df.columns, F.inline_outer(F.array(row)))


Scorer = Callable[[DataFrame], DataFrame]
_PREDICTED = ("sentiment", "confidence", "model")


@dataclass(frozen=True)
class LinearScorer:
    """All linear models of a table. Scores in place: every row passes, and no row moves."""

    vocabulary: DataFrame
    coefficients: DataFrame
    intercepts: dict[str, float]
    tags: dict[str, str]
    clean: bool

    def add(self, rows: DataFrame, names: Sequence[str], id_col: str) -> DataFrame:
        """Fill sentiment, confidence and model of the valid rows that request one of ``names``."""
        mine = (F.col("status") == 200) & F.col("requested").isin(*names) & F.col("requested").isin(*self.intercepts)
        text = clean_for_classical(F.col("text")) if self.clean else F.col("text")
        keep = [c for c in rows.columns if c != id_col]
        scored = term_scores(
            rows.withColumn("__features", F.when(mine, text)), self.vocabulary, self.coefficients, self.intercepts,
            id_col, "__features", keep,
        )
        margin, tag = F.element_at("margins", F.col("requested")), F.create_map(*[F.lit(x) for kv in self.tags.items() for x in kv])
        new = margin_to_prediction(
            scored.select(id_col, *[c for c in keep if c not in _PREDICTED], *[F.col(c).alias(f"__{c}") for c in _PREDICTED], "margins"),
            margin, F.element_at(tag, F.col("requested")),
        )
        filled = [F.when(mine, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in _PREDICTED]
        return new.select(id_col, *[c for c in keep if c not in _PREDICTED], *filled)


def linear_scorer(
    vocabulary: DataFrame,
    coefficients: DataFrame,
    intercepts: dict[str, float],
    tags: dict[str, str] = MODEL_TAGS,
    clean: bool = True,
) -> LinearScorer:
    """Scorer for all linear models of a table, in one pass.

    ``clean=False`` scores the text as it came, without the cleaning of the training texts.
    """
    return LinearScorer(vocabulary, coefficients, intercepts, tags, clean)


def batch_model_scorer(
    make_predict: Callable, prepare: Callable[[DataFrame], DataFrame], input_cols: Sequence[str],
    tag: str, id_col: str = "request_id", batch_size: int = 32, input_shapes=None,
) -> Scorer:
    """Scorer for a user's model that turns prepared columns into two logits."""

    def score(valid: DataFrame) -> DataFrame:
        logits = batch_scores(prepare(valid), input_cols, make_predict, batch_size, input_shapes)
        return logits_to_prediction(logits, "logits", tag).select(
            id_col, "input_length", "sentiment", "confidence", "model"
        )

    return score


def score_requests(
    validated: DataFrame, scorers: dict[tuple[str, ...], Scorer | LinearScorer], id_col: str = "request_id"
) -> DataFrame:
    """One response row per request: (id, status, error, message, sentiment, confidence, model, input_length).

    Errors and the requests of all linear scorers take one pass over the bodies. Any other
    scorer sees only the valid requests naming one of its models, in a pass of its own.
    A valid request for a model without scorer has a null prediction.
    """
    valid = F.col("status") == 200
    elsewhere = [m for names, s in scorers.items() if not isinstance(s, LinearScorer) for m in names]
    rows = validated.withColumn("input_length", F.when(valid, F.length("text")))
    responses = rows.where(~(valid & F.col("requested").isin(*elsewhere))) if elsewhere else rows
    kinds = {"sentiment": "string", "confidence": "double", "model": "string"}
    responses = responses.select(
        id_col, "status", "error", "message", "text", "requested", "input_length",
        *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()],
    )
    for names, scorer in scorers.items():
        if isinstance(scorer, LinearScorer):
            responses = scorer.add(responses, names, id_col)
    columns = [id_col, "status", "error", "message", *_PREDICTED, "input_length"]
    responses = responses.select(*columns)
    for names, scorer in scorers.items():
        if not isinstance(scorer, LinearScorer):
            scored = scorer(rows.where(valid & F.col("requested").isin(*names)))
            nothing = [F.lit(None).cast("string").alias(c) for c in ("error", "message")]
            responses = responses.unionByName(scored.select(id_col, F.lit(200).alias("status"), *nothing, *_PREDICTED, "input_length"))
    return responses


def prediction_id(batch: str, request_id: Column) -> Column:
    """A UUID named by batch and request (version 5 layout of a SHA-1), the same whenever the batch is scored again."""
    digest = F.sha1(F.concat(F.lit(f"{batch}:"), F.coalesce(request_id.cast("string"), F.lit(""))))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def log_rows(responses: DataFrame, latency_ms: float | None = None, batch: str = "", id_col: str = "request_id") -> DataFrame:
    """Prediction log: one row per successfully scored request.

    The id is derived from ``batch`` and the request's id, so scoring a batch again gives the
    same rows; a request id that comes twice in a batch is one request.
    """
    rows = responses.where(F.col("status") == 200).select(
        prediction_id(batch, F.col(id_col)).alias("prediction_id"),
        epoch_seconds().alias("timestamp"),
        "sentiment",
        "confidence",
        "model",
        "input_length",
        F.lit(latency_ms).cast("double").alias("latency_ms"),
        F.lit("success").alias("status"),
    )
    return rows.dropDuplicates(["prediction_id"])
