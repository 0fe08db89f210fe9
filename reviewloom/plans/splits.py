"""Build the stored splits: remove leaks, split, clean, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.cleaning import add_clean_columns, word_count
from reviewloom.operators.leakage import digest, drop_digests, drop_listed, warn_if_nothing_removed
from reviewloom.operators.splitting import SEED, VALIDATION_FRACTION, stratified_split
from reviewloom.sinks.tables import write_splits
from reviewloom.storage import materialise


def build_corpus_splits(
    corpus: DataFrame, dataset: str, path: str, fraction: float = VALIDATION_FRACTION, seed: int = SEED
) -> dict[str, int]:
    """Write train, validation and test of (id, text_raw, label, split) below ``path``.

    The texts are read twice: once for a narrow table of digests, from which
    leaks and cut points follow, and once for the map-only pass that writes.
    Returns the rows of train before and after leak removal.
    """
    narrow = materialise(
        corpus.select("id", "label", "split", digest(F.col("text_raw")).alias("digest")), "digests"
    )
    is_train, is_test = F.col("split") == "train", F.col("split") == "test"
    leaked = (
        narrow.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max(is_train).alias("in_train"), F.max(is_test).alias("in_test"))
        .where("in_train AND in_test")
        .select("digest")
    )
    leaked = materialise(leaked, "leaked")
    train_keys = narrow.where(is_train)
    kept_keys = materialise(
        drop_listed(train_keys, leaked, ["id"]).select("id", "label"), "kept-keys"
    )
    before, after = train_keys.count(), kept_keys.count()
    warn_if_nothing_removed(before - after)

    train = drop_digests(corpus.where(is_train).drop("split"), leaked, "text_raw")
    parts = stratified_split(train, fraction=fraction, seed=seed, keys=kept_keys)
    every = parts.unionByName(corpus.where(is_test))
    write_splits(
        add_clean_columns(every)
        .withColumn("word_count", word_count(F.col("text_raw")))
        .withColumn("dataset", F.lit(dataset)),
        path,
    )
    return {"rows_before": before, "rows_after": after, "rows_removed": before - after}


def build_second_corpus_splits(corpus: DataFrame, dataset: str, path: str) -> None:
    """Clean (text_raw, split[, label, ...]) as it is; splits are kept, null counts as one word."""
    write_splits(
        add_clean_columns(corpus)
        .withColumn("word_count", word_count(F.col("text_raw"), null_as_word=True))
        .withColumn("dataset", F.lit(dataset)),
        path,
    )
