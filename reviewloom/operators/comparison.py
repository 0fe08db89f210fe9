"""Comparison of measured models with a baseline, and what to carry forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewloom.functions.scoring import delta, ratio, reduction_pct

NOT_MEASURED = "NOT YET MEASURED"
DASH = "—"


def expected_models(measured: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every expected model in order; ``status`` tells which were measured."""
    spark = measured.sparkSession
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "model string, pos int")
    return wanted.join(measured, "model", "left").withColumn(
        "status", F.when(F.col("f1").isNull(), NOT_MEASURED).otherwise("measured")
    )


def evaluated_models(metrics: DataFrame, timings: DataFrame, sizes: DataFrame, measured_on: str) -> DataFrame:
    """One record per model: metrics, timings, size and where the timings were taken.

    ``metrics``: (model, accuracy, precision, recall, f1, confusion_matrix); ``timings``: (model,
    n_measured, mean_ms, ...); ``sizes``: (model, size_mb). A model without timings or size keeps
    its metrics.
    """
    quality = [c for c in metrics.columns if c != "model"]
    timed = [c for c in timings.columns if c != "model"]
    return (
        metrics.select(F.col("model"), F.struct(*quality).alias("test_metrics"))
        .join(timings.select(F.col("model"), F.struct(*timed).alias("test_latency_ms")), "model", "left")
        .join(sizes.select("model", F.col("size_mb").alias("model_size_mb")), "model", "left")
        .select(
            F.col("model").alias("model_name"), "test_metrics", "test_latency_ms", "model_size_mb",
            F.when(F.col("test_latency_ms").isNotNull(), measured_on).alias("latency_measured_on"),
        )
    )


def with_baseline(models: DataFrame, baseline: str) -> DataFrame:
    """Add base_f1, base_size_mb, base_latency_ms from the one baseline row.

    The table has one row per expected model, so one task sees all of it.
    """
    whole = Window.partitionBy()
    is_base = F.col("model") == baseline
    return models.select(
        "*",
        *[
            F.max(F.when(is_base, F.col(c))).over(whole).alias(f"base_{c}")
            for c in ("f1", "size_mb", "latency_ms")
        ],
    )


def verdict(models: DataFrame, baseline: str) -> DataFrame:
    """One row per other model: F1 gain, size and latency multiples, a sentence."""
    gain = F.col("f1_delta")
    sentence = F.when(
        F.col("status") == NOT_MEASURED,
        F.format_string("%s: no figures so far.", F.col("model")),
    ).otherwise(
        F.format_string(
            "%s against %s: F1 %s (%+.4f), size times %.1f, mean time times %.1f.",
            F.col("model"), F.lit(baseline), F.when(gain > 0, "higher").otherwise("not higher"), gain,
            F.col("size_ratio"), F.col("latency_ratio"),
        )
    )
    return (
        with_baseline(models, baseline)
        .where(F.col("model") != baseline)
        .withColumn("f1_delta", delta(F.col("f1"), F.col("base_f1")))
        .withColumn("beats_baseline", gain > 0)
        .withColumn("size_ratio", ratio(F.col("size_mb"), F.col("base_size_mb"), 1))
        .withColumn("latency_ratio", ratio(F.col("latency_ms"), F.col("base_latency_ms"), 1))
        .withColumn("summary", sentence)
        .select("model", "status", "f1_delta", "beats_baseline", "size_ratio", "latency_ratio", "summary")
    )


def is_worthwhile(f1_delta: Column, size_reduction_pct: Column, speedup: Column) -> Column:
    """Fixed rule on the rounded values: F1 loss below 0.01, and smaller by
    more than 5 % or faster by more than 1.1 times."""
    return (f1_delta > -0.01) & ((size_reduction_pct > 5) | (speedup > 1.1))


def variant_summary(
    models: DataFrame, original: str, unscored: Sequence[str] = (), artifacts: DataFrame | None = None
) -> DataFrame:
    """Deltas of every variant against the original model.

    ``artifacts``: (model, artifact_path); adds the path, and ``same_machine``: whether the
    timings come from where the original's do (null if that is unknown). Variants in ``unscored`` are informational: ``worthwhile`` is null and they
    are never recommended.
    """
    facts = []
    if artifacts is not None:
        here = F.max(F.when(F.col("model") == original, F.col("measured_on"))).over(Window.partitionBy())
        models = models.withColumn("same_machine", F.col("measured_on") == here).join(artifacts, "model", "left")
        facts = ["same_machine", "artifact_path"]
    scored = is_worthwhile(F.col("f1_delta"), F.col("size_reduction_pct"), F.col("speedup"))
    return (
        with_baseline(models, original)
        .where((F.col("model") != original) & F.col("f1").isNotNull())
        .withColumn("f1_delta", delta(F.col("f1"), F.col("base_f1")))
        .withColumn("size_reduction_pct", reduction_pct(F.col("size_mb"), F.col("base_size_mb")))
        .withColumn("speedup", ratio(F.col("base_latency_ms"), F.col("latency_ms"), 2))
        .withColumn("worthwhile", F.when(~F.col("model").isin(*unscored), scored) if unscored else scored)
        .select(
            "model", "pos", "f1", "size_mb", "latency_ms", "base_latency_ms",
            "f1_delta", "size_reduction_pct", "speedup", "worthwhile", *facts,
        )
    )


def best_variant(variants: DataFrame) -> DataFrame:
    """One row: the fastest worthwhile variant (first listed wins ties), or a null name."""
    pick = F.min_by(
        F.struct("model", "f1_delta", "size_reduction_pct", "latency_ms", "base_latency_ms"),
        F.struct("latency_ms", "pos"),
    )
    best = variants.where("worthwhile").agg(pick.alias("b")).select("b.*")
    decision = F.when(F.col("model").isNull(), "Keep the original: no variant pays off.").otherwise(
        F.format_string(
            "Take %s: F1 changes by %+.4f, %.1f%% smaller, mean time %.1f ms instead of %.1f ms.",
            "model", "f1_delta", "size_reduction_pct", "latency_ms", "base_latency_ms",
        )
    )
    return best.select(F.col("model").alias("recommended_variant"), decision.alias("decision"))


def comparison_rows(models: DataFrame) -> DataFrame:
    """Markdown table rows in model order; placeholders for unmeasured models."""
    measured = F.format_string(
        "| %s | %.4f | %.4f | %.3f | %.3f |", "model", "accuracy", "f1", "size_mb", "latency_ms"
    )
    missing = F.format_string(f"| %s | {NOT_MEASURED} | {NOT_MEASURED} | -- | -- |", "model")
    return models.select(
        "pos", F.when(F.col("status") == NOT_MEASURED, missing).otherwise(measured).alias("line")
    )


def variant_rows(variants: DataFrame) -> DataFrame:
    """Markdown rows of the variant table."""
    flag = F.when(F.col("worthwhile"), "Yes").when(~F.col("worthwhile"), "No").otherwise("N/A")
    return variants.select(
        "pos",
        F.format_string(
            "| %s | %+.4f | %.1f%% | %.1f | %s |", "model", "f1_delta", "size_reduction_pct", "latency_ms", flag
        ).alias("line"),
    )


def chart_rows(models: DataFrame) -> DataFrame:
    """Models with a measured accuracy; other missing numbers shown as a dash."""
    shown = [
        F.when(F.col(c).isNull(), DASH).otherwise(F.format_string("%.4f", c)).alias(c)
        for c in ("f1", "size_mb", "latency_ms")
    ]
    return models.where(F.col("accuracy").isNotNull()).select(
        "model", F.format_string("%.4f", "accuracy").alias("accuracy"), *shown
    )


def _document(spark, head: Sequence[str], rows: DataFrame, tail: DataFrame) -> DataFrame:
    """(pos, line) in order: fixed head, table rows (pos, line), blank line, closing lines (pos, line)."""
    start = spark.createDataFrame(list(enumerate(head)), "pos int, line string")
    first = len(head)
    body = rows.select((F.col("pos") + first).cast("int").alias("pos"), "line")
    # A handful of rows: one for each model.
    end = tail.select((F.col("pos") + 1_000_000).cast("int").alias("pos"), "line")
    return start.unionByName(body).unionByName(end)


def comparison_document(models: DataFrame, verdicts: DataFrame, title: str = "Model comparison") -> DataFrame:
    """(pos, line) of a Markdown document: table with where timings were taken, and the verdicts.

    ``models`` has a column ``measured_on`` (null: shown as a dash).
    """
    head = [
        f"# {title}", "",
        "| Model | Accuracy | F1 | Size (MB) | Mean time (ms) | Measured on |", "|---|---|---|---|---|---|",
    ]
    place = models.select("pos", F.coalesce("measured_on", F.lit("--")).alias("place"))
    rows = comparison_rows(models).join(place, "pos").select("pos", F.concat("line", F.lit(" "), "place", F.lit(" |")).alias("line"))
    order = models.select("model", (F.col("pos") + 10).alias("pos"))
    closing = models.sparkSession.createDataFrame([(0, ""), (1, "## Verdict"), (2, "")], "pos int, line string")
    closing = closing.unionByName(verdicts.join(order, "model").select("pos", F.concat(F.lit("- "), "summary").alias("line")))
    return _document(models.sparkSession, head, rows, closing)


def variant_document(variants: DataFrame, best: DataFrame, title: str = "Variants") -> DataFrame:
    """(pos, line) of a Markdown document: table of the variants and the decision."""
    head = [f"# {title}", "", "| Variant | F1 change | Size reduction | Mean time (ms) | Worthwhile |", "|---|---|---|---|---|"]
    closing = variants.sparkSession.createDataFrame([(0, ""), (1, "## Decision"), (2, "")], "pos int, line string")
    closing = closing.unionByName(best.select(F.lit(3).alias("pos"), F.col("decision").alias("line")))
    return _document(variants.sparkSession, head, variant_rows(variants), closing)
