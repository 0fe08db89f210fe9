"""Readers for labelled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.scoring import class_label
from reviewloom.sinks.snapshots import read_partitions

_FILE = r"([^/]+)/(pos|neg)/([^/]+)\.txt$"


def scan_labelled_directory(
    spark: SparkSession, root: str, corpus: str, splits: Sequence[str] = ("train", "test")
) -> DataFrame:
    """(id, text_raw, label, split) from ``root/<split>/{pos,neg}/<stem>.txt``.

    Other class folders are not listed. Bytes that are not UTF-8 are replaced
    and line ends become ``\\n``. Such a tree is many small files: read it once
    and store Parquet.
    """
    # Folders only: their files are listed by the tasks, not by a glob on the driver.
    folders = f"{root.rstrip('/')}/{{{','.join(splits)}}}/{{pos,neg}}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folders)

    def part(i):
        return F.regexp_extract("path", _FILE, i)

    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.concat_ws("_", F.lit(corpus), part(1), part(2), part(3)).alias("id"),
        F.regexp_replace(text, "\r\n?", "\n").alias("text_raw"),
        class_label(part(2)).alias("label"),
        part(1).alias("split"),
    )


def discover_splits(spark: SparkSession, folder: str) -> list[str]:
    """Names of the ``*.csv`` entries of a folder, sorted."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.csv")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().removesuffix(".csv") for s in fs.globStatus(pattern) or [])


def scan_csv_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split with its text column renamed to ``text_raw``.

    The text column is ``sentence`` if there is one, else the first. A
    ``label`` column becomes an integer; other columns stay strings.
    """
    df = spark.read.csv(
        f"{folder.rstrip('/')}/{split}.csv", header=True, multiLine=True, quote='"', escape='"'
    )
    text_col = "sentence" if "sentence" in df.columns else df.columns[0]
    df = df.withColumnRenamed(text_col, "text_raw")
    if "label" in df.columns:
        df = df.withColumn("label", F.col("label").try_cast("int"))
    return df.withColumn("split", F.lit(split))


def scan_csv_splits(spark: SparkSession, folder: str, splits: Sequence[str] | None = None) -> DataFrame:
    """Union of the named (or all discovered) splits; missing columns are null."""
    names = list(splits) if splits is not None else discover_splits(spark, folder)
    if not names:
        raise FileNotFoundError(f"no *.csv below {folder}")
    frames = [scan_csv_split(spark, folder, s) for s in names]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def scan_processed(
    spark: SparkSession, path: str, dataset: str | None = None, split: str | None = None,
    text_col: str = "text_clean_classical",
) -> DataFrame:
    """Stored splits of the newest snapshot; null texts read as ``""``. Other splits are not read."""
    wanted = {k: v for k, v in (("dataset", dataset), ("split", split)) if v is not None}
    df = read_partitions(spark, path, wanted)
    if df is None:
        # A folder written without snapshots: filters prune its partitions.
        df = spark.read.parquet(path)
        for key, value in wanted.items():
            df = df.where(F.col(key) == value)
    return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
