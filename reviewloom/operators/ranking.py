"""Exact ranks inside large groups without sorting a group in one task.

``rank_cuts`` serves keys that are hashes (splits, samples, folds): their
prefixes are uniform, so counts per prefix locate a rank, and only the rows of
one prefix are ordered. ``order_statistics`` serves arbitrary numbers: equal
values are merged first, then a range shuffle spreads even a single huge group
over many tasks and offsets of the tasks give the global rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewloom.storage import materialise

PREFIX_LENGTH = 4  # hex digits: 65,536 buckets per group


def order_hash(id_col: Column, seed: int) -> Column:
    """Seeded, engine-independent order key of a row id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def rank_cuts(keyed: DataFrame, ranks: DataFrame) -> DataFrame:
    """Key found at each wanted rank.

    ``keyed``: (grp, h, id), ordered within ``grp`` by (h, id).
    ``ranks``: (grp, cut, k), 1-based ranks; only ranks that exist give a row.
    Returns (grp, cut, cut_key STRUCT<h, id>).
    """
    prefix = F.substring("h", 1, PREFIX_LENGTH)
    by_prefix = keyed.groupBy("grp", prefix.alias("prefix")).agg(F.count("*").alias("n"))
    running = Window.partitionBy("grp").orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    located = (
        by_prefix.withColumn("upto", F.sum("n").over(running))
        .join(ranks, "grp")
        .where((F.col("k") > F.col("upto") - F.col("n")) & (F.col("k") <= F.col("upto")))
        .select("grp", "cut", "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("within"))
    )
    # One row per (group, cut): callers pass a fixed list of labels and cuts.
    inside = keyed.withColumn("prefix", prefix).join(F.broadcast(located), ["grp", "prefix"])
    place = F.row_number().over(Window.partitionBy("grp", "cut").orderBy("h", "id"))
    return (
        inside.withColumn("place", place)
        .where(F.col("place") == F.col("within"))
        .select("grp", "cut", F.struct("h", "id").alias("cut_key"))
    )


def order_statistics(
    df: DataFrame, group_cols: Sequence[str], value_col: str, ranks: dict[str, Column]
) -> DataFrame:
    """Exact order statistics and moments per group.

    ``ranks`` maps an output name to a 0-based rank expressed on the column
    ``n`` (rows of the group). Returns group_cols, n, total, and one column per
    rank. Null values are ignored.
    """
    group_cols = list(group_cols)
    merged = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, F.col(value_col).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    ordered = merged.repartitionByRange(*[F.col(c) for c in group_cols], F.col("v"))
    # Written once: the slice numbers must be the same for every reader.
    ordered = materialise(ordered.withColumn("slice", F.spark_partition_id()), "ordered")

    slices = ordered.groupBy(*group_cols, "slice").agg(
        F.sum("c").alias("in_slice"), F.sum(F.col("v") * F.col("c")).alias("slice_total")
    )
    whole = Window.partitionBy(*group_cols)
    running = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = (
        slices.withColumn("n", F.sum("in_slice").over(whole))
        .withColumn("total", F.sum("slice_total").over(whole))
        .withColumn("before", F.sum("in_slice").over(running) - F.col("in_slice"))
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("stat"), rank.cast("long").alias("k")) for name, rank in ranks.items()]
    )
    targets = (
        slices.select("*", F.explode(wanted).alias("t"))
        .select("*", "t.stat", "t.k")
        .where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("in_slice")))
        .select(*group_cols, "slice", "stat", "k", "before", "n", "total")
    )
    keys = [*group_cols, "slice"]
    within = Window.partitionBy(*keys).orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Only slices that hold a wanted rank are ordered.
    upto = (
        ordered.join(targets.select(*keys).distinct(), keys, "left_semi")
        .withColumn("upto", F.sum("c").over(within))
    )
    hits = (
        upto.join(targets, keys)
        .withColumn("upto", F.col("upto") + F.col("before"))
        .where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
    )
    return hits.groupBy(*group_cols).agg(
        F.max("n").alias("n"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("stat") == name, F.col("v"))).alias(name) for name in ranks],
    )


def timing_statistics(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Mean, median, p95, min and max of a timing column, three decimals.

    p95 is the value at 0-based rank ``min(int(0.95 n), n - 1)``, without
    interpolation; the median of an even count is the mean of the middle two.
    """
    n = F.col("n")
    stats = order_statistics(
        df,
        group_cols,
        value_col,
        {
            "lowest": F.lit(0),
            "mid_low": F.floor((n - 1) / 2),
            "mid_high": F.floor(n / 2),
            # 95 n / 100 in whole numbers; equals int(0.95 n) for every count.
            "p95": F.least(F.floor(n * 95 / 100), n - 1),
            "highest": n - 1,
        },
    )
    return stats.select(
        *group_cols,
        F.col("n").alias("n_measured"),
        F.round(F.col("total") / n, 3).alias("mean_ms"),
        F.round((F.col("mid_low") + F.col("mid_high")) / 2, 3).alias("median_ms"),
        F.round("p95", 3).alias("p95_ms"),
        F.round("lowest", 3).alias("min_ms"),
        F.round("highest", 3).alias("max_ms"),
    )
