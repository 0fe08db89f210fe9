"""Nested JSON reports: written pretty, read with a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.storage import path_exists

METRICS_SCHEMA = (
    "accuracy double, precision double, recall double, f1 double, confusion_matrix array<array<bigint>>"
)
LATENCY_SCHEMA = (
    "n_measured bigint, mean_ms double, median_ms double, p95_ms double, min_ms double, max_ms double"
)
MODEL_REPORT_SCHEMA = (
    f"model_name string, test_metrics struct<{METRICS_SCHEMA}>, "
    f"test_latency_ms struct<{LATENCY_SCHEMA}>, model_size_mb double, latency_measured_on string"
)


def write_report(report: DataFrame, path: str) -> None:
    """One pretty JSON array with an object per row, overwriting; reports are a few rows."""
    document = report.agg(F.to_json(F.collect_list(F.struct("*")), {"pretty": "true"}).alias("value"))
    document.write.mode("overwrite").text(path)


def write_document(lines: DataFrame, path: str) -> None:
    """Lines (pos, line) of a document as one text file; documents are a few rows."""
    lines.orderBy("pos").coalesce(1).select("line").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a stored document."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    return whole.select(F.posexplode(lines).alias("pos", "line"))


def read_report(spark: SparkSession, path: str, schema: str = MODEL_REPORT_SCHEMA, required: bool = True):
    """The report, or None if it is optional and absent."""
    if not path_exists(spark, path):
        if required:
            raise FileNotFoundError(f"report not found at {path}; run the step that writes it first")
        return None
    return spark.read.schema(schema).json(path, multiLine=True)


def model_rows(report: DataFrame) -> DataFrame:
    """(model, accuracy, f1, size_mb, latency_ms, measured_on) of model reports."""
    return report.select(
        F.col("model_name").alias("model"),
        F.col("test_metrics.accuracy").alias("accuracy"),
        F.col("test_metrics.f1").alias("f1"),
        F.col("model_size_mb").alias("size_mb"),
        F.col("test_latency_ms.mean_ms").alias("latency_ms"),
        F.col("latency_measured_on").alias("measured_on"),
    )
