"""Facts about files: counts against expectation, checksums, sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files expected per split and class; unsup is shown, not checked.
EXPECTED_FILES = {
    ("train", "pos"): 12500,
    ("train", "neg"): 12500,
    ("train", "unsup"): 50000,
    ("test", "pos"): 12500,
    ("test", "neg"): 12500,
}
UNCHECKED_CLASSES = ("unsup",)
MEGABYTE = 1024 * 1024


def _files(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def file_manifest(
    spark: SparkSession, root: str, expected: Mapping[tuple[str, str], int] = EXPECTED_FILES, glob: str = "*.txt"
) -> DataFrame:
    """(split, class, n_files, expected, matches) for every expected folder.

    File contents are never read. ``matches`` is null where counts are shown
    only.
    """
    found = (
        _files(spark, root, glob)
        .select(
            F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("split"),
            F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2).alias("class"),
        )
        .groupBy("split", "class")
        .agg(F.count("*").alias("n_files"))
    )
    wanted = spark.createDataFrame(
        [(s, c, n) for (s, c), n in expected.items()], "split string, class string, expected long"
    )
    return (
        wanted.join(found, ["split", "class"], "left")
        .withColumn("n_files", F.coalesce("n_files", F.lit(0)))
        .withColumn(
            "matches",
            F.when(~F.col("class").isin(*UNCHECKED_CLASSES), F.col("n_files") == F.col("expected")),
        )
        .select("split", "class", "n_files", "expected", "matches")
    )


LARGE_FILE, CHUNK = 512 * MEGABYTE, 8 * MEGABYTE


def _chunked_sha1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            files, name = (
                (fs.LocalFileSystem(), unquote(urlsplit(path).path)) if path.startswith("file:") else fs.FileSystem.from_uri(path)
            )
            digest = hashlib.sha1()
            with files.open_input_stream(name) as source:
                while part := source.read(CHUNK):
                    digest.update(part)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "n_bytes", "sha1"])


def checksums(spark: SparkSession, root: str, glob: str | None = None, large: int = LARGE_FILE) -> DataFrame:
    """(path, n_bytes, sha1) of every file below ``root``.

    Files above ``large`` bytes are read in chunks by the tasks, through a file system that
    Arrow knows; a smaller one is one row of Spark's reader.
    """
    files = _files(spark, root, glob)
    small = files.where(F.col("length") <= large).select(
        "path", F.col("length").alias("n_bytes"), F.sha1("content").alias("sha1")
    )
    big = files.where(F.col("length") > large).select("path", F.col("length").alias("n_bytes"))
    return small.unionByName(big.mapInArrow(_chunked_sha1, "path string, n_bytes long, sha1 string"))


def artifact_sizes(spark: SparkSession, artifacts: Mapping[str, Sequence[str]]) -> DataFrame:
    """(artifact, size_mb): files and folders of each artifact, three decimals.

    Every path is rounded before the sum, as sizes are reported per path.
    """
    parts = [
        _files(spark, path).select(F.lit(name).alias("artifact"), F.lit(i).alias("part"), "length")
        for name, paths in artifacts.items()
        for i, path in enumerate(paths)
    ]
    lengths = parts[0]
    for part in parts[1:]:
        lengths = lengths.unionByName(part)
    return (
        lengths.groupBy("artifact", "part")
        .agg(F.round(F.sum("length") / MEGABYTE, 3).alias("mb"))
        .groupBy("artifact")
        .agg(F.round(F.sum("mb"), 3).alias("size_mb"))
    )
