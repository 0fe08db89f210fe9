"""Classification metrics per model, and the choice of a setting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, by: Sequence[str], label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """(by, tn, fp, fn, tp). A label or prediction other than 0 and 1 (or null) is an error."""
    y, p = (
        F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{c} must be 0 or 1, found "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        )
        for c in (label_col, pred_col)
    )
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class, four decimals.

    A zero denominator gives 0.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def rate(a, b):
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)

    return (
        counts.withColumn("accuracy", rate(tp + tn, tn + fp + fn + tp))
        .withColumn("precision", rate(tp, tp + fp))
        .withColumn("recall", rate(tp, tp + fn))
        .withColumn("f1", rate(2 * tp, 2 * tp + fp + fn))
    )


def classification_metrics(
    df: DataFrame, by: Sequence[str], label_col: str = "label", pred_col: str = "pred"
) -> DataFrame:
    """Metrics and ``confusion_matrix`` [[TN, FP], [FN, TP]] per group."""
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return (
        with_metrics(confusion_counts(df, by, label_col, pred_col))
        .withColumn("confusion_matrix", matrix)
        .drop("tn", "fp", "fn", "tp")
    )


def best_setting(grid: DataFrame, position_col: str = "grid_pos", score_col: str = "f1") -> DataFrame:
    """Row with the highest score; the earliest grid entry wins ties."""
    return grid.orderBy(F.desc(score_col), F.asc(position_col)).limit(1)
