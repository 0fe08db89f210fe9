"""Request validation and scoring; bodies are made from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import (
    HASH_INTERCEPTS, hash_coefficients, sql_blank, sql_classical, sql_margins, sql_vocabulary,
    sql_weights, stored_vocabulary, text_table,
)
from reviewloom.catalog.scoring import sql_prediction
from reviewloom.operators.requests import MODEL_TAGS, linear_scorer, log_rows, score_requests, validate_requests
from reviewloom.sinks.tables import append_log
from reviewloom.storage import scratch_path
from reviewloom.streaming.requests import REQUEST_SCHEMA, read_requests, start_request_stream

#: Bodies that only a lenient parser takes, and what they mean: the last of repeated keys counts, NaN is a number.
TWICE, NOT_A_NUMBER = '{"text":"first","x":[1],"text":"The last one counts."}', '{"text":NaN,"model":-Infinity}'
TWO_MODELS = '{"text":"Fine.","model":"other","model":"distilbert"}'
MEANT = {TWICE: '{"text":"The last one counts."}', NOT_A_NUMBER: '{"text":0,"model":0}', TWO_MODELS: '{"text":"Fine.","model":"distilbert"}'}

_RESPONSE = ["request_id", "status", "error", "message", "sentiment", "confidence", "model"]


def request_bodies(spark, sf_dir):
    """(request_id, method, body): well-formed requests and every kind of bad one."""
    turns = text_table(spark, sf_dir, "conversations", "conv_id", "turn").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text")
    digest = F.md5(F.concat(F.lit("kind:"), "request_id"))
    kind, sub = F.substring(digest, 1, 1), F.substring(digest, 2, 1)

    def body(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    plain = body(text=F.col("text"))
    return turns.select(
        "request_id",
        F.when((kind == "f") & (sub < "4"), "GET").otherwise("POST").alias("method"),
        F.when(kind < "8", plain)
        .when(kind == "8", body(text=F.col("text"), model=F.lit("distilbert")))
        .when(kind == "9", body(text=F.col("text"), model=F.lit("logreg")))
        .when(kind == "a", body(text=F.col("text"), model=F.lit("other")))
        .when(kind == "b", F.concat(F.expr("left(to_json(struct(text)), length(to_json(struct(text))) - 1)"), F.lit(',"model":null}')))
        .when(kind == "c", F.when(sub < "4", '{"text":5}').when(sub < "8", TWICE).when(sub < "c", NOT_A_NUMBER).otherwise(TWO_MODELS))
        .when(kind == "d", F.lit('{"model":"logreg"}'))
        .when(kind == "e", F.when(sub < "4", F.lit(None)).when(sub < "8", "").when(sub < "c", F.col("text")).otherwise("[5]"))
        .when(sub < "4", plain)
        .when(sub < "8", F.lit('{"text":null}'))
        .when(sub < "c", F.lit('{"text":"  \\n\\t "}'))
        .otherwise(body(text=F.repeat("text", F.lit(60))))
        .alias("body"),
    )


def validate(spark, sf_dir):
    return validate_requests(request_bodies(spark, sf_dir)).select(
        "request_id", "status", "error", "message", "requested", F.length("text").alias("input_length")
    )


def _scorers(spark, sf_dir):
    vocabulary = stored_vocabulary(spark, sf_dir)
    scorer = linear_scorer(
        vocabulary, hash_coefficients(vocabulary), HASH_INTERCEPTS
    )
    return {tuple(MODEL_TAGS): scorer}


def request_predictions(spark, sf_dir):
    validated = validate_requests(request_bodies(spark, sf_dir))
    return score_requests(validated, _scorers(spark, sf_dir)).select(*_RESPONSE)


def prediction_log(spark, sf_dir):
    """The stored log without its random ids and clock."""
    responses = score_requests(validate_requests(request_bodies(spark, sf_dir)), _scorers(spark, sf_dir))
    path = scratch_path(spark, "prediction-log")
    append_log(log_rows(responses), path)
    return spark.read.parquet(path).select("sentiment", "confidence", "model", "input_length", "status")


def request_stream(spark, sf_dir):
    """The streaming twin of ``request_predictions``."""
    incoming = scratch_path(spark, "incoming")
    request_bodies(spark, sf_dir).write.parquet(incoming)
    # Fitted once; every micro-batch reads the stored table.
    vocabulary = stored_vocabulary(spark, sf_dir)
    scorer = linear_scorer(
        vocabulary, hash_coefficients(vocabulary), HASH_INTERCEPTS
    )
    results = scratch_path(spark, "responses")
    stream = start_request_stream(
        read_requests(spark, incoming), {tuple(MODEL_TAGS): scorer}, results,
        scratch_path(spark, "stream-log"), scratch_path(spark, "stream-state"), available_now=True,
    )
    stream.awaitTermination()
    return spark.read.parquet(results).select(*_RESPONSE)


QUERIES = {
    "validate_requests": validate,
    "request_predictions": request_predictions,
    "prediction_log": prediction_log,
    "request_stream": request_stream,
}

_BODIES = """turns AS (SELECT conv_id || '-' || turn AS request_id, text,
        substr(md5('kind:' || conv_id || '-' || turn), 1, 1) AS kind,
        substr(md5('kind:' || conv_id || '-' || turn), 2, 1) AS sub FROM conversations),
    bodies AS (SELECT request_id, CASE WHEN kind = 'f' AND sub < '4' THEN 'GET' ELSE 'POST' END AS method,
        CASE WHEN kind < '8' THEN CAST(json_object('text', text) AS VARCHAR)
        WHEN kind = '8' THEN CAST(json_object('text', text, 'model', 'distilbert') AS VARCHAR)
        WHEN kind = '9' THEN CAST(json_object('text', text, 'model', 'logreg') AS VARCHAR)
        WHEN kind = 'a' THEN CAST(json_object('text', text, 'model', 'other') AS VARCHAR)
        WHEN kind = 'b' THEN CAST(json_object('text', text, 'model', NULL) AS VARCHAR)
        WHEN kind = 'c' AND sub < '4' THEN '{"text":5}' WHEN kind = 'c' AND sub < '8' THEN '""" + TWICE + """'
        WHEN kind = 'c' AND sub < 'c' THEN '""" + NOT_A_NUMBER + """' WHEN kind = 'c' THEN '""" + TWO_MODELS + """'
        WHEN kind = 'd' THEN '{"model":"logreg"}'
        WHEN kind = 'e' AND sub < '4' THEN NULL WHEN kind = 'e' AND sub < '8' THEN ''
        WHEN kind = 'e' AND sub < 'c' THEN text WHEN kind = 'e' THEN '[5]'
        WHEN sub < '4' THEN CAST(json_object('text', text) AS VARCHAR)
        WHEN sub < '8' THEN '{"text":null}' WHEN sub < 'c' THEN '{"text":"  \\n\\t "}'
        ELSE CAST(json_object('text', repeat(text, 60)) AS VARCHAR) END AS body FROM turns)"""
_MEANT = " ".join(f"WHEN '{body}' THEN '{meant}'" for body, meant in MEANT.items())
_CHECKED = f"""{_BODIES},
    read AS (SELECT * REPLACE (CASE body {_MEANT} ELSE body END AS body) FROM bodies),
    parsed AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM read),
    fields AS (SELECT *, json_type(j) AS top, json_type(j, '$.text') AS tt, json_type(j, '$.model') AS mt,
               json_extract_string(j, '$.text') AS text, json_extract_string(j, '$.model') AS asked FROM parsed),
    ruled AS (SELECT *, CASE WHEN method <> 'POST' THEN 'method' WHEN body IS NULL THEN 'no_body'
        WHEN j IS NULL THEN 'not_json' WHEN top <> 'OBJECT' THEN 'not_object'
        WHEN tt IS NULL OR tt = 'NULL' THEN 'no_text' WHEN tt <> 'VARCHAR' THEN 'text_type'
        WHEN {sql_blank('text')} THEN 'blank' WHEN length(text) > 5000 THEN 'too_long'
        WHEN mt IS NOT NULL AND (mt <> 'VARCHAR' OR asked NOT IN ('logreg', 'distilbert')) THEN 'model'
        ELSE 'ok' END AS rule FROM fields),
    rules(rule, status, error, message) AS (VALUES
        ('method', 405, 'method_not_allowed', 'Only POST is supported.'),
        ('no_body', 400, 'invalid_request', 'Request body is required.'),
        ('not_json', 400, 'invalid_request', 'Request body must be valid JSON.'),
        ('not_object', 500, 'internal_error', 'An internal error occurred.'),
        ('no_text', 422, 'validation_error', 'The ''text'' field is required.'),
        ('text_type', 422, 'validation_error', 'The ''text'' field must be a string.'),
        ('blank', 422, 'validation_error', 'The ''text'' field cannot be empty or whitespace-only.'),
        ('too_long', 422, 'validation_error', 'The ''text'' field exceeds the maximum length of 5000 characters.'),
        ('model', 422, 'validation_error', 'The ''model'' field must be one of [''distilbert'', ''logreg''].'),
        ('ok', 200, NULL, NULL)),
    checked AS (SELECT request_id, status, error, message,
        CASE WHEN status = 200 THEN text END AS text,
        CASE WHEN status = 200 THEN coalesce(asked, 'logreg') END AS requested FROM ruled JOIN rules USING (rule))"""
_SCORED = f"""{sql_vocabulary()}, {_CHECKED},
    valid AS (SELECT request_id, requested, {sql_classical('text')} AS clean FROM checked WHERE status = 200),
    {sql_weights('v', 'valid', 'request_id', 'clean')}, {sql_margins('v', 'valid', 'request_id')},
    answered AS (SELECT request_id, {sql_prediction('margin')}, CASE requested WHEN 'logreg'
        THEN 'tfidf-logreg-v1.0' ELSE 'distilbert-onnx-int8' END AS model
        FROM valid JOIN v_m USING (request_id) WHERE v_m.model = requested)"""
_RESPONSES = f"""WITH {_SCORED} SELECT request_id, status, error, message, sentiment, confidence, model
    FROM checked LEFT JOIN answered USING (request_id)"""

ORACLES = {
    "validate_requests": f"""WITH {_CHECKED} SELECT request_id, status, error, message, requested,
        CAST(length(text) AS INTEGER) AS input_length FROM checked""",
    "request_predictions": _RESPONSES,
    "request_stream": _RESPONSES,
    "prediction_log": f"""WITH {_SCORED} SELECT sentiment, confidence, model,
        CAST(length(text) AS INTEGER) AS input_length, 'success' AS status
        FROM checked JOIN answered USING (request_id)""",
}
