"""Reproducible stratified splits, samples and folds.

All three order each label by a seeded hash of the row id and cut that order
at exact ranks. The wide rows are never shuffled: the cut keys (a handful per
label) are joined back by broadcast, and the last pass is map-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewloom.operators.ranking import order_hash, rank_cuts
from reviewloom.storage import materialise

SEED = 42
VALIDATION_FRACTION = 0.10
FOLDS = 5
#: Labels a split may have; its cut keys, a handful for each, are broadcast.
MOST_LABELS = 10_000


def _stored_keys(df: DataFrame, id_col: str, label_col: str, keys: DataFrame | None) -> DataFrame:
    """(id, label) of all rows; written once, because sizes and cuts read it several times. Ids that repeat are an error."""
    keys = keys if keys is not None else materialise(df.select(id_col, label_col), "split-keys")
    repeated = keys.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"id {repeated[0][0]!r} occurs {repeated[0][1]} times; sizes of splits are exact only for unique ids")
    return keys


def _keyed(keys: DataFrame, id_col: str, label_col: str, seed: int) -> DataFrame:
    return keys.select(
        F.col(label_col).alias("grp"), order_hash(F.col(id_col), seed).alias("h"), F.col(id_col).alias("id")
    )


def _label_sizes(keys: DataFrame, label_col: str) -> DataFrame:
    """(grp, size), a row for each label that occurs; a null label is an error."""
    sizes = keys.groupBy(F.col(label_col).alias("grp")).agg(F.count("*").alias("size"))
    rows = sizes.limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels; a split by label is for a column of classes")
    unlabelled = sum(r["size"] for r in rows if r["grp"] is None)
    if unlabelled:
        raise ValueError(f"{unlabelled} rows have no label; give them one or leave them out before the split")
    return keys.sparkSession.createDataFrame(rows, sizes.schema)


def validation_quota(sizes: DataFrame, fraction: float) -> DataFrame:
    """Rows per label: ``ceil(fraction * n)`` shared by largest remainder.

    ``sizes``: (grp, size), one row per label. Ties go to the smaller label.
    """
    over_all = Window.partitionBy()
    share = F.col("want") * F.col("size") / F.col("n")
    by_remainder = Window.orderBy(F.desc("remainder"), F.asc("grp"))
    return (
        sizes.withColumn("n", F.sum("size").over(over_all))
        .withColumn("want", F.ceil(F.round(F.lit(fraction) * F.col("n"), 9)))
        .withColumn("k", F.floor(share))
        .withColumn("remainder", F.round(share - F.floor(share), 9))
        .withColumn("missing", F.col("want") - F.sum("k").over(over_all))
        .withColumn("k", F.col("k") + F.when(F.row_number().over(by_remainder) <= F.col("missing"), 1).otherwise(0))
        .select("grp", "k")
    )


def _with_cuts(df: DataFrame, cuts: DataFrame, id_col: str, label_col: str, seed: int) -> DataFrame:
    """Join the sorted cut keys of its label to every row of ``df``."""
    per_label = cuts.groupBy(F.col("grp").alias(label_col)).agg(
        F.array_sort(F.collect_list("cut_key")).alias("__cuts")
    )
    key = F.struct(order_hash(F.col(id_col), seed).alias("h"), F.col(id_col).alias("id"))
    return df.withColumn("__key", key).join(F.broadcast(per_label), label_col, "left")


def stratified_split(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "label",
    fraction: float = VALIDATION_FRACTION,
    seed: int = SEED,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: 'validation' for an exact share of every label, else 'train'.

    ``keys`` may hold the (id, label) columns of the same rows when a narrower
    stored table of them exists. Every label that occurs is split; rows without a label
    raise an error.
    """
    keys = _stored_keys(df, id_col, label_col, keys)
    quota = validation_quota(_label_sizes(keys, label_col), fraction)
    ranks = quota.select("grp", F.lit(1).alias("cut"), "k")
    cuts = rank_cuts(_keyed(keys, id_col, label_col, seed), ranks)
    wide = _with_cuts(df, cuts, id_col, label_col, seed)
    chosen = F.coalesce(F.col("__key") <= F.element_at("__cuts", 1), F.lit(False))
    return wide.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("__key", "__cuts")


def stratified_sample(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "label",
    size: int = 3000,
    seed: int = SEED,
) -> DataFrame:
    """At most ``size // 2`` rows of each label, only if there are more than ``size`` rows."""
    keys = _stored_keys(df, id_col, label_col, None)
    sizes = _label_sizes(keys, label_col)
    n = F.sum("size").over(Window.partitionBy())
    quota = sizes.select(
        "grp",
        F.lit(1).alias("cut"),
        F.when(n > size, F.least(F.col("size"), F.lit(size // 2))).otherwise(F.col("size")).alias("k"),
    )
    cuts = rank_cuts(_keyed(keys, id_col, label_col, seed), quota)
    wide = _with_cuts(df, cuts, id_col, label_col, seed)
    return wide.where(F.col("__key") <= F.element_at("__cuts", 1)).drop("__key", "__cuts")


def stratified_folds(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "label",
    folds: int = FOLDS,
    seed: int = SEED,
) -> DataFrame:
    """Add ``fold`` 1..folds; fold sizes of a label differ by at most one row."""
    keys = _stored_keys(df, id_col, label_col, None)
    sizes = _label_sizes(keys, label_col)
    i = F.col("cut")
    last = i * F.floor(F.col("size") / folds) + F.least(i, F.col("size") % folds)
    ranks = (
        sizes.select("*", F.explode(F.array(*[F.lit(c) for c in range(1, folds)])).alias("cut"))
        .select("grp", "cut", last.alias("k"))
        .where("k > 0")
    )
    cuts = rank_cuts(_keyed(keys, id_col, label_col, seed), ranks)
    wide = _with_cuts(df, cuts, id_col, label_col, seed)
    passed = F.size(F.filter(F.col("__cuts"), lambda cut: cut < F.col("__key")))
    return wide.withColumn("fold", F.coalesce(passed, F.lit(0)) + 1).drop("__key", "__cuts")
