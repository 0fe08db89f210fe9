"""Readers, manifests and stored splits.

Round trips write the given tables in the layout the reader expects and read
them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import (
    SQL_LABELLED, documents, labelled, sql_classical, sql_transformer, sql_word_count, table, text_table,
)
from reviewloom.functions.cleaning import add_clean_columns, word_count
from reviewloom.sinks.files import write_text_files
from reviewloom.sinks.tables import write_split_csv, write_splits
from reviewloom.sources.corpus import scan_csv_splits, scan_labelled_directory, scan_processed
from reviewloom.sources.manifest import artifact_sizes, checksums, file_manifest
from reviewloom.storage import materialise, scratch_path, spread

TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]


def directory_scan(spark, sf_dir):
    """Labelled documents as one file per row below split/class, scanned back."""
    root = scratch_path(spark, "tree")
    folder = F.concat("split", F.lit("/"), F.when(F.col("label") == 1, "pos").otherwise("neg"))
    rows = labelled(spark, sf_dir).where(F.col("label").isin(0, 1)).select(folder.alias("folder"), "text")
    rows = materialise(rows, "labelled")
    write_text_files(spread(rows), root, [f"{split}/{name}" for split in ("train", "test") for name in ("pos", "neg")])
    return scan_labelled_directory(spark, root, "docs").select("text_raw", "label", "split")


def csv_scan(spark, sf_dir):
    folder = scratch_path(spark, "csv")
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    for split in ("train", "test"):
        part = docs.where(F.col("split") == split)
        write_split_csv(
            part.select(F.col("text").alias("sentence"), F.col("quality").alias("label"), "doc_id"),
            f"{folder}/{split}.csv",
        )
    return scan_csv_splits(spark, folder).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text_raw", "label", "split"
    )


def write_read_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    rows = labelled(spark, sf_dir).select(
        "doc_id", F.col("text").alias("text_raw"), "label", F.col("lang").alias("dataset"), "split"
    )
    write_splits(add_clean_columns(rows).withColumn("word_count", word_count(F.col("text_raw"))), path)
    return scan_processed(spark, path).select(
        "doc_id", "label", "dataset", "split", "text_clean_classical", "text_clean_transformer", "word_count"
    )


def manifest(spark, sf_dir):
    """Parquet files of the given tables against one expected file per table."""
    scale = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    parent = sf_dir.rstrip("/").rsplit("/", 1)[0].rsplit("/", 1)[-1]
    return file_manifest(spark, sf_dir, {(parent, scale): len(TABLES), (parent, "absent"): 1}, "*.parquet")


CLASSES = ("pos", "neg", "unsup")
#: Files expected of each split and class of the written pages; most are wrong on purpose.
EXPECTED_PAGES = {("train", "pos"): 55, ("train", "neg"): 40, ("train", "unsup"): 1, ("test", "pos"): 42, ("test", "neg"): 0, ("test", "absent"): 0}


def _page_files(spark, sf_dir, classes=CLASSES):
    """One file for each page below split/class, by digits of a digest of its id."""
    root = scratch_path(spark, "page-files")
    digest = F.md5(F.col("page_id").cast("string"))
    split = F.when(F.substring(digest, 1, 1) < "8", "train").otherwise("test")
    name = F.when(F.substring(digest, 2, 1) < "6", "pos").when(F.substring(digest, 2, 1) < "c", "neg").otherwise("unsup")
    pages = text_table(spark, sf_dir, "pages", "page_id").select(
        F.concat(split, F.lit("/"), name).alias("folder"), F.coalesce("html", F.lit("")).alias("text")
    )
    pages = materialise(pages, "pages")
    write_text_files(spread(pages), root, [f"{split}/{name}" for split in ("train", "test") for name in classes])
    return root


def page_manifest(spark, sf_dir):
    return file_manifest(spark, _page_files(spark, sf_dir), EXPECTED_PAGES)


def page_checksums(spark, sf_dir):
    """Length and checksum of every written file; files above 1 kB are read in chunks."""
    return checksums(spark, _page_files(spark, sf_dir), "*.txt", large=1024).select("n_bytes", "sha1")


def page_artifacts(spark, sf_dir):
    """Sizes of folders and of groups of them."""
    root = _page_files(spark, sf_dir)
    folders = {name: [f"{root}/train/{name}"] for name in CLASSES}
    return artifact_sizes(spark, folders | {"labelled": [f"{root}/{s}/{c}" for s in ("train", "test") for c in ("pos", "neg")], "all": [root]})


QUERIES = {
    "page_manifest": page_manifest,
    "page_checksums": page_checksums,
    "page_artifacts": page_artifacts,
    "directory_scan": directory_scan,
    "csv_scan": csv_scan,
    "write_read_splits": write_read_splits,
    "file_manifest": manifest,
    "checksums": lambda s, d: checksums(s, d, "*.parquet"),
    "artifact_size": lambda s, d: artifact_sizes(
        s, {"text": [f"{d}/documents.parquet", f"{d}/pages.parquet"], "labels": [f"{d}/labels.parquet"]}
    ),
}

_PAGES = """p AS MATERIALIZED (SELECT coalesce(html, '') || chr(10) AS content,
    CASE WHEN substr(md5(CAST(page_id AS VARCHAR)), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split,
    CASE WHEN substr(md5(CAST(page_id AS VARCHAR)), 2, 1) < '6' THEN 'pos' WHEN substr(md5(CAST(page_id AS VARCHAR)), 2, 1) < 'c' THEN 'neg'
    ELSE 'unsup' END AS class FROM pages)"""
_MEGABYTES = "round(sum(strlen(content)) / 1048576.0, 3)"

ORACLES = {
    "page_manifest": f"""WITH {_PAGES}, wanted(split, class, expected) AS (VALUES {", ".join(f"('{s}', '{c}', CAST({n} AS BIGINT))" for (s, c), n in EXPECTED_PAGES.items())}),
        found AS (SELECT split, class, count(*) AS n FROM p GROUP BY ALL)
        SELECT split, class, coalesce(n, 0) AS n_files, expected, CASE WHEN class <> 'unsup' THEN coalesce(n, 0) = expected END AS matches
        FROM wanted LEFT JOIN found USING (split, class)""",
    "page_checksums": f"WITH {_PAGES} SELECT strlen(content) AS n_bytes, sha1(content) AS sha1 FROM p",
    "page_artifacts": f"""WITH {_PAGES}, parts AS (
        SELECT class AS artifact, {_MEGABYTES} AS mb FROM p WHERE split = 'train' GROUP BY class
        UNION ALL SELECT 'labelled', {_MEGABYTES} FROM p WHERE class <> 'unsup' GROUP BY split, class
        UNION ALL SELECT 'all', {_MEGABYTES} FROM p)
        SELECT artifact, round(sum(mb), 3) AS size_mb FROM parts GROUP BY artifact""",
    "directory_scan": f"""WITH {SQL_LABELLED} SELECT
        regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10) AS text_raw, label, split
        FROM labelled WHERE label IN (0, 1)""",
    "csv_scan": """SELECT doc_id, text AS text_raw, quality AS label, CASE WHEN
        substr(md5('split:' || doc_id), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "write_read_splits": f"""WITH {SQL_LABELLED} SELECT doc_id, label, lang AS dataset, split,
        {sql_classical('text')} AS text_clean_classical, {sql_transformer('text')} AS text_clean_transformer,
        {sql_word_count('text')} AS word_count FROM labelled""",
}
