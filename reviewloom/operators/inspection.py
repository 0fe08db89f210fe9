"""Quality report of a labelled corpus.

The report is one pass over the texts: rows are merged per text digest, which
drops every copy before the shuffle, and all counts are sums over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.cleaning import is_blank, word_count
from reviewloom.operators.leakage import digest

TOTAL, OTHER = "total", "other"


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split and in total."""
    return (
        df.rollup(split_col)
        .agg(F.count("*").alias("n_rows"))
        .select(F.coalesce(F.col(split_col), F.lit(TOTAL)).alias("split"), "n_rows")
    )


def class_balance(df: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    return df.groupBy(F.col(split_col).alias("split"), F.col(label_col).alias("label")).agg(
        F.count("*").alias("n_rows")
    )


def class_balance_map(df: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    """Nested form: one map of label to rows per split."""
    pairs = F.array_sort(F.collect_list(F.struct("label", "n_rows")))
    return class_balance(df, split_col, label_col).groupBy("split").agg(
        F.map_from_entries(pairs).alias("class_balance")
    )


def duplicate_rows(df: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each text, in total or per group."""
    per_text = df.groupBy(*by, digest(F.col(text_col)).alias("digest")).agg(F.count("*").alias("n"))
    return per_text.groupBy(*by).agg(
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicate_rows")
    )


def missing_texts(df: DataFrame, text_col: str, by: Sequence[str] = (), blanks: bool = True) -> DataFrame:
    """Null texts, and blank ones when ``blanks``."""
    missing = is_blank(F.col(text_col)) if blanks else F.col(text_col).isNull()
    return df.groupBy(*by).agg(F.count_if(missing).alias("missing_texts"))


def word_count_statistics(
    df: DataFrame, text_col: str, by: Sequence[str] = (), null_as_word: bool = False, median: bool = True
) -> DataFrame:
    """Min, max, mean (one decimal) and interpolated median of the word count.

    The histogram of word counts is built first, so no aggregate holds more
    than the distinct counts.
    """
    histogram = df.groupBy(*by, word_count(F.col(text_col), null_as_word).alias("words")).agg(
        F.count("*").alias("n")
    )
    known = F.when(F.col("words").isNotNull(), F.col("n"))
    stats = [
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
        F.round(F.sum(F.col("words") * F.col("n")) / F.sum(known), 1).alias("mean_words"),
    ]
    if median:
        stats.append(F.percentile("words", 0.5, F.col("n")).alias("median_words"))
    return histogram.groupBy(*by).agg(*stats)


def unlabelled_splits(df: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    """Splits whose labels are all the placeholder -1."""
    return df.groupBy(F.col(split_col).alias("split")).agg(
        F.bool_and(F.col(label_col) == -1).alias("unlabelled")
    )


def source_status(counts: DataFrame, expected: Sequence[str], found: Sequence[str] | None = None) -> DataFrame:
    """'missing', 'empty' or 'ok' for every expected source.

    ``counts``: (source, n_rows). ``found`` names the sources that exist; a found
    source without a count is empty. Without it, a source without a count is
    missing.
    """
    spark = counts.sparkSession
    present = set(found or ())
    wanted = spark.createDataFrame([(s, s in present) for s in expected], "source string, present boolean")
    return wanted.join(counts, "source", "left").select(
        "source",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(F.col("n_rows") > 0, "ok")
        .when(F.col("present") | (F.col("n_rows") == 0), "empty")
        .otherwise("missing")
        .alias("status"),
    )


def inspection_summary(
    df: DataFrame,
    text_col: str,
    splits: Sequence[str],
    split_col: str = "split",
    label_col: str | None = "label",
    found: Sequence[str] | None = None,
    null_as_word: bool = False,
    blanks: bool = True,
    median: bool = True,
) -> DataFrame:
    """A row for each expected split, one for all other rows (``other``), one for the total.

    One shuffle by text digest, and a small one for the labels, which does not read the
    texts. ``other`` takes rows of unexpected splits and rows without a split; the
    total has every row. ``class_balance`` maps each label that occurs (``none`` for null)
    to its rows. ``found`` names splits whose source exists, see ``source_status``.
    """
    names = [*splits, OTHER]
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in splits]), F.col(split_col)), F.lit(0))
    slot = F.when(place > 0, place - 1).otherwise(len(splits))
    label = F.coalesce(F.col(label_col).cast("string"), F.lit("none")) if label_col else F.lit("none")
    missing = is_blank(F.col(text_col)) if blanks else F.col(text_col).isNull()

    rows = df.select(
        digest(F.col(text_col)).alias("digest"), word_count(F.col(text_col), null_as_word).alias("words"), missing.alias("blank"),
        slot.alias("slot"), label.alias("label"),
    )
    per_text = rows.groupBy("digest").agg(
        F.array(*[F.count_if(F.col("slot") == i) for i in range(len(names))]).alias("n"),
        F.first("words").alias("words"),
        F.first("blank").alias("blank"),
    )

    def block(name, n, overlap):
        has = n > 0
        words = F.col("words")
        return F.struct(
            F.lit(name).alias("split"),
            F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(n) - F.count_if(has), F.lit(0)).alias("duplicate_texts"),
            F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("missing_texts"),
            F.min(F.when(has, words)).alias("min_words"),
            F.max(F.when(has, words)).alias("max_words"),
            F.round(F.try_divide(F.sum(words * n), F.sum(F.when(words.isNotNull(), n))), 1).alias("mean_words"),
            (F.percentile("words", 0.5, n) if median else F.lit(None).cast("double")).alias("median_words"),
            overlap.alias("cross_split_texts"),
        )

    total = F.aggregate(F.col("n"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    in_many = F.col("digest").isNotNull() & (F.size(F.filter("n", lambda x: x > 0)) > 1)
    blocks = [block(s, F.get("n", F.lit(i)), F.count_if(in_many & (F.get("n", F.lit(i)) > 0))) for i, s in enumerate(names)]
    blocks.append(block(TOTAL, total, F.count_if(in_many)))
    measured = per_text.agg(F.array(*blocks).alias("rows")).select(F.inline("rows"))
    if label_col:
        position = F.posexplode(F.concat(F.array(*[F.lit(s) for s in names]), F.array(F.lit(TOTAL))))
        counted = rows.groupBy("slot", "label").agg(F.count("*").alias("n"))
        counted = counted.select("label", "slot", "n", position.alias("i", "split")).where("slot = i or i = %d" % len(names))
        counted = counted.groupBy("split", "label").agg(F.sum("n").alias("n"))
        balance = counted.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_balance"))
        measured = measured.join(balance, "split", "left")
    present = F.col("split").isin(*(found or ())) if found else F.lit(False)
    status = F.when(F.col("n_rows") > 0, "ok").when(present, "empty").otherwise("missing")
    # The row for unexpected splits appears only if there are any.
    return measured.withColumn("status", status).where((F.col("split") != OTHER) | (F.col("n_rows") > 0))
