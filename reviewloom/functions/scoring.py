"""Row-level scoring arithmetic: logits, probabilities, labels, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label names.
LABEL_NAMES = {0: "negative", 1: "positive"}
CLASS_LABELS = {"pos": 1, "neg": 0}


def label_name(label: Column) -> Column:
    return F.when(label == 1, LABEL_NAMES[1]).when(label == 0, LABEL_NAMES[0])


def class_label(folder: Column) -> Column:
    return F.when(folder == "pos", CLASS_LABELS["pos"]).when(
        folder == "neg", CLASS_LABELS["neg"]
    )


def softmax(logits: Column) -> Column:
    """Probabilities of an ARRAY<DOUBLE>, shifted by the maximum."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(probabilities: Column, predicted: Column) -> Column:
    """Probability of the predicted class, four decimals."""
    return F.round(F.element_at(probabilities, predicted + 1), 4)


def logits_to_prediction(df, logits_col: str, model_tag: str):
    """Add pred, sentiment, confidence and model for a column of logits."""
    return (
        df.withColumn("__p", softmax(F.col(logits_col).cast("array<double>")))
        .withColumn("pred", argmax(F.col(logits_col)))
        .withColumn("sentiment", label_name(F.col("pred")))
        .withColumn("confidence", confidence(F.col("__p"), F.col("pred")))
        .withColumn("model", F.lit(model_tag))
        .drop("__p")
    )


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


#: Splits a double into two halves whose products are exact.
_SPLITTER = 134217729.0


def round_exact(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals the double as it is stored, ties to even.

    ``F.round`` rounds the shortest decimal form half-up: 2.675, stored a little below, becomes 2.68 there
    and 2.67 here. The product with the power of ten is taken together with its rounding error
    (an exact product of halves), so a value next to a tie falls on the side it lies on.
    """
    x, scale = x.cast("double"), float(10**digits)
    scale_high = _SPLITTER * scale - (_SPLITTER * scale - scale)
    scale_low = scale - scale_high
    product = x * scale
    high = x * _SPLITTER - (x * _SPLITTER - x)
    low = x - high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    nearest = F.rint(product)
    # Only a product that looks like a tie can hide on which side of it the value lies.
    tie = F.abs(product - F.floor(product) - 0.5) == 0
    whole = F.when(tie & (error > 0), F.floor(product) + 1.0).when(tie & (error < 0), F.floor(product) + 0.0).otherwise(nearest)
    return F.when(F.isnan(x) | (F.abs(product) >= 2.0**52), x).otherwise(whole / scale)


def delta(a: Column, b: Column, digits: int = 4) -> Column:
    return round_exact(a - b, digits)


def ratio(a: Column, b: Column, digits: int = 2) -> Column:
    return round_exact(F.try_divide(a, b), digits)


def reduction_pct(a: Column, b: Column) -> Column:
    """How much smaller ``a`` is than ``b``, in percent, one decimal."""
    return round_exact((1 - F.try_divide(a, b)) * 100, 1)


def display_percent(conf: Column) -> Column:
    return F.round(conf * 1000) / 10


def preview(text: Column, width: int = 40) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("…"))).otherwise(
        text
    )


def new_row_id() -> Column:
    return F.uuid()


def epoch_seconds() -> Column:
    return F.unix_timestamp(F.current_timestamp())
