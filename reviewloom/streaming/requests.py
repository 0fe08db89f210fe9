"""The request job as a stream: stateless, append only."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.requests import Scorer, log_rows, score_requests, validate_requests
from reviewloom.sinks.tables import append_log

REQUEST_SCHEMA = "request_id string, method string, body string"


def read_requests(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New Parquet files of (request_id, method, body) as they arrive."""
    return (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def _handle(scorers: dict[tuple[str, ...], Scorer], results: str, log_path: str) -> Callable:
    def handle(batch: DataFrame, batch_id: int) -> None:
        started = time.perf_counter()
        out = f"{results.rstrip('/')}/batch_id={batch_id}"
        # Overwriting the batch's own folder makes a repeated batch harmless.
        score_requests(batch, scorers).write.mode("overwrite").parquet(out)
        elapsed_ms = (time.perf_counter() - started) * 1000
        responses = batch.sparkSession.read.parquet(out).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = responses.count()
            append_log(log_rows(responses, round(elapsed_ms / max(n, 1), 3), str(batch_id)), log_path, batch_id)
        finally:
            responses.unpersist()

    return handle


def start_request_stream(
    requests: DataFrame,
    scorers: dict[tuple[str, ...], Scorer],
    results: str,
    log_path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Validate, score and log a stream of requests.

    Responses are written first; the log write is separate and cannot fail
    them. ``latency_ms`` in the log is the batch time divided by its requests.
    """
    writer = (
        validate_requests(requests)
        .writeStream.foreachBatch(_handle(scorers, results, log_path))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
