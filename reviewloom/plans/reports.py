"""Reports of whole runs, one row each, for ``write_report``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.features import TfidfSettings
from reviewloom.operators.inspection import inspection_summary
from reviewloom.operators.training import Tuning
from reviewloom.plans.training import Features
from reviewloom.sources.corpus import discover_splits, scan_csv_splits
from reviewloom.storage import path_exists


def _rows(df: DataFrame, name: str, order: str) -> DataFrame:
    """All rows of a small frame as one array column, ordered by one of its columns."""
    fields = [order, *[c for c in df.columns if c != order]]
    return df.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def existing(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that exist below ``root``."""
    return [n for n in names if path_exists(spark, f"{root.rstrip('/')}/{n}")]


def inspect_directory(spark: SparkSession, rows: DataFrame, root: str, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Inspection of a labelled folder; the status tells missing folders from empty ones."""
    return inspection_summary(rows, "text_raw", splits, found=existing(spark, root, splits))


def inspect_csv_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Inspection of every CSV split of a folder: null texts only, no median, labels if there are any.

    A missing or empty folder gives one row ``total`` with that status.
    """
    names = discover_splits(spark, folder)
    if not names:
        status = "empty" if path_exists(spark, folder) else "missing"
        return spark.createDataFrame([("total", 0, status)], "split string, n_rows long, status string")
    rows = scan_csv_splits(spark, folder, names)
    label = "label" if "label" in rows.columns else None
    files = [f"{n}.csv" for n in names]
    found = [f.removesuffix(".csv") for f in existing(spark, folder, files)]
    return inspection_summary(rows, "text_raw", names, label_col=label, found=found, null_as_word=True, blanks=False, median=False)


def inspection_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row with the summaries of both corpora."""
    return _rows(first, "first_corpus", "split").join(_rows(second, "second_corpus", "split"))


def training_report(
    name: str, tuned: Tuning, features: Features, validation_metrics: DataFrame, timings: DataFrame, size_mb: float,
    settings: TfidfSettings = TfidfSettings(),
) -> DataFrame:
    """One row: all candidates, the chosen one, vectoriser settings, validation metrics, timings and size.

    The candidates of a fit share their passes over the data, so that passes are reported, not
    seconds of each.
    """
    spark = tuned.grid.sparkSession
    passes = spark.createDataFrame([(f.c, f.passes) for f in tuned.fits], "C double, passes int")
    chosen = F.struct(F.lit(tuned.best.c).alias("C"), F.lit(tuned.best.iterations).alias("iterations"), F.lit(tuned.best.converged).alias("converged"))
    vectoriser = F.struct(
        F.lit(settings.max_features).alias("max_features"), F.lit(settings.min_df).alias("min_df"), F.lit(settings.max_df).alias("max_df"),
        F.lit(features.n_features).alias("vocabulary_size"),
    )
    return (
        _rows(tuned.grid.join(passes, "C"), "candidates", "grid_pos")
        .join(_rows(validation_metrics, "validation_metrics", "model"))
        .join(_rows(timings, "timings", timings.columns[0]))
        .select(F.lit(name).alias("model_name"), chosen.alias("selected"), vectoriser.alias("vectoriser"), "*", F.lit(size_mb).alias("model_size_mb"))
    )


def comparison_report(models: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: the models in order (unmeasured ones with their status) and the verdicts."""
    return _rows(models, "models", "pos").join(_rows(verdicts, "verdicts", "model"))


def variant_report(original: DataFrame, variants: DataFrame, best: DataFrame) -> DataFrame:
    """One row: the original's figures, the variants, the recommendation."""
    figures = original.select(F.struct("f1", "size_mb", "latency_ms").alias("original"))
    return figures.join(_rows(variants, "variants", "pos")).join(best)
