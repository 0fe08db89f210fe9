"""Texts that occur in both the train and the test split.

Texts are compared by their SHA-256, so 32 bytes per text are shuffled, not
the text. Digests are made distinct before they meet, which also removes any
hot text. The wide train rows do not move when the shared digests are few.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.storage import materialise

# A digest row takes about 100 bytes as broadcast; this keeps it below 128 MB.
BROADCAST_DIGESTS = 1_000_000
SALTS = 32


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shared_digests(train: DataFrame, test: DataFrame, text_col: str) -> DataFrame:
    """Distinct digests present in both frames."""
    left = train.where(F.col(text_col).isNotNull()).select(digest(F.col(text_col)).alias("digest")).distinct()
    right = test.where(F.col(text_col).isNotNull()).select(digest(F.col(text_col)).alias("digest")).distinct()
    return left.join(right, "digest", "left_semi")


def drop_digests(df: DataFrame, digests: DataFrame, text_col: str, how: str = "left_anti") -> DataFrame:
    """Anti (or semi) join of wide rows with a distinct digest table, see ``drop_listed``."""
    others = [c for c in df.columns if c != text_col]
    return drop_listed(df.withColumn("digest", digest(F.col(text_col))), digests, others, how).drop("digest")


def drop_listed(keyed: DataFrame, digests: DataFrame, basis: Sequence[str], how: str = "left_anti") -> DataFrame:
    """Anti (or semi) join of rows that carry a ``digest`` with a distinct digest table.

    The table is broadcast only after its rows were counted. A larger one is
    joined by shuffle, with every digest repeated per salt so that the copies of
    a hot text are spread over ``SALTS`` tasks. The salt comes from the columns in ``basis``.
    """
    if digests.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        return keyed.join(F.broadcast(digests), "digest", how)
    salted = digests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A salt from other columns is the same when a task runs again.
    value = F.xxhash64(*basis) if basis else F.monotonically_increasing_id()
    spread = keyed.withColumn("salt", F.pmod(value, F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["digest", "salt"], how).drop("salt")


def remove_leaked_rows(train: DataFrame, test: DataFrame, text_col: str = "text_raw") -> DataFrame:
    """Train rows whose text is in no test row; copies within train stay.

    The shared digests are written first: counting and joining them then reads
    that table and not the texts again.
    """
    shared = materialise(shared_digests(train, test, text_col), "shared-digests")
    return drop_digests(train, shared, text_col)


def leak_counts(df: DataFrame, text_col: str, split_col: str) -> DataFrame:
    """One row: train rows before and after removal, rows removed, distinct shared texts."""
    is_train = F.col(split_col) == "train"
    per_text = (
        df.groupBy(digest(F.col(text_col)).alias("digest"))
        .agg(
            F.count_if(is_train).alias("n_train"),
            F.count_if(F.col(split_col) == "test").alias("n_test"),
        )
    )
    shared = F.col("digest").isNotNull() & (F.col("n_train") > 0) & (F.col("n_test") > 0)
    return per_text.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(shared, F.col("n_train"))), F.lit(0)).alias("rows_removed"),
        F.count_if(shared).alias("shared_texts"),
    ).select(
        "rows_before",
        (F.col("rows_before") - F.col("rows_removed")).alias("rows_after"),
        "rows_removed",
        "shared_texts",
    )


def warn_if_nothing_removed(removed: int) -> None:
    if removed == 0:
        warnings.warn("no train row overlaps the test split; check that the raw data is complete", stacklevel=2)
