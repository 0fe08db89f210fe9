"""Stored splits, fitted models and the prediction log."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sinks.snapshots import overwrite_partitions
from reviewloom.storage import path_exists

log = logging.getLogger(__name__)


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet by dataset and split; the splits in ``df`` replace the old ones together, others stay."""
    overwrite_partitions(df, path, ("dataset", "split"))


def write_split_csv(df: DataFrame, path: str) -> None:
    """CSV with every value quoted, so that texts keep line breaks and outer spaces."""
    df.write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def save_vocabulary(vocabulary: DataFrame, path: str) -> DataFrame:
    """Store a fitted vocabulary once; every model reads this copy."""
    vocabulary.write.mode("overwrite").parquet(path)
    return load_vocabulary(vocabulary.sparkSession, path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, idx int, df bigint, cf bigint, idf double").parquet(path)


def save_models(models: DataFrame, path: str) -> None:
    """(model, term, coef) partitioned by model; the intercept has a null term."""
    (
        models.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def load_models(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Coefficients (model, term, coef) and the intercept of each model."""
    stored = spark.read.schema("term string, coef double, model string").parquet(path)
    bias = stored.where(F.col("term").isNull()).select("model", "coef").collect()  # one row per model
    coefficients = stored.where(F.col("term").isNotNull()).select("model", "term", "coef")
    return coefficients, {r["model"]: r["coef"] for r in bias}


def append_log(rows: DataFrame, path: str, batch_id: int | None = None) -> bool:
    """Append to the log; a failure is reported and never raised.

    Rows whose ``prediction_id`` the log has already are left out, so a batch that is
    scored again after a failure is logged once. With a batch id the rows form their own
    partition, replaced when the same batch runs again.
    """
    try:
        if batch_id is not None:
            rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
            return True
        spark = rows.sparkSession
        if path_exists(spark, path):
            known = spark.read.schema("prediction_id string").parquet(path)
            rows = rows.join(known, "prediction_id", "left_anti")
        rows.write.mode("append").parquet(path)
        return True
    except Exception:
        log.exception("prediction log not written; the results are not affected")
        return False
