"""Training-data pipeline: stages over ``documents``, each written as Parquet and read again.

All stages but the last return the columns they were given, whatever other columns there are and however they are
called. Repeated ids are rows of their own, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm.common import table
from reviewloom.llm.decontamination import drop_contaminated
from reviewloom.llm.packing import pack_documents
from reviewloom.llm.personal_data import mask, train
from reviewloom.llm.quality import fit_quality, keep_good
from reviewloom.llm.simhash_dedup import keep_first, similar_components
from reviewloom.storage import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality trees score at least 0.5 (ties stay); null and empty texts are scored as empty."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of documents alike in 0.8 of their five-word shingles, the one with the smallest id.

    Null and empty texts are one group; texts of fewer words are alike if their words are the same in the same order. A
    null id is never the smallest; of rows that repeat the smallest id any one stays.
    """
    return keep_first(docs, similar_components(docs, size=5, similarity=0.8))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage within the edit budget; null and empty texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; null and empty texts stay as they are."""
    return mask(docs, train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every piece of every document in a training sequence; a null or empty text is its end token alone."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Trained models and alignment have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
