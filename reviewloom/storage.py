"""Intermediate tables in the folder the cluster shares.

Work that several later passes read (digests, fitted vocabularies, feature
rows for an iterative fit) is written once as Parquet below the folder named by
``spark.checkpoint.dir``. That cuts lineage, survives the loss of executors and
keeps column pruning for the readers.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="reviewloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def scratch_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back with the same schema."""
    spark = df.sparkSession
    path = path or scratch_path(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a stored table that arrives in fewer splits than cores.

    Text work is CPU-bound, so a small table in one file is worth a shuffle. A
    large table has more splits than cores and is returned as it is. Only for
    plain scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in a local or mounted file system, whose files tasks can map into memory; None in other stores."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None
