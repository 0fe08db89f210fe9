"""Partitioned tables that change as a whole.

Every write goes to a folder of its own below the table, ``version=<id>/dataset=<d>/split=<s>``, and becomes visible by one
small file ``_snapshots/<number>.json`` that lists the folder of each partition; readers follow the
highest number. A write that dies leaves folders nobody lists, and a reader that has resolved a
snapshot keeps its files until ``remove_old_versions`` is called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SNAPSHOTS = "_snapshots"


class SnapshotConflict(RuntimeError):
    """Two writers took the same number again and again."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, sorted; none if it does not exist."""
    files, place = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/{SNAPSHOTS}") if n.endswith(".json")]


def _read(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    files, place = _file_system(spark, f"{path}/{SNAPSHOTS}/{number:012d}.json")
    stream = files.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current_partitions(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Partition (``dataset=d/split=s``) -> folder below ``path``, of the newest snapshot; None if there is none."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[-1]) if numbers else None


def _commit(spark: SparkSession, path: str, number: int, partitions: dict[str, str]) -> bool:
    """Publish a snapshot under a number nobody has taken; False if somebody was faster."""
    files, waiting = _file_system(spark, f"{path}/{SNAPSHOTS}/.{uuid.uuid4().hex}")
    out = files.create(waiting, False)
    out.write(json.dumps(partitions, sort_keys=True).encode())
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SNAPSHOTS}/{number:012d}.json")
    # The written file appears under its name in one step, and never over another.
    if not files.exists(target) and files.rename(waiting, target):
        return True
    files.delete(waiting, False)
    return False


def overwrite_partitions(df: DataFrame, path: str, keys: Sequence[str], attempts: int = 10) -> None:
    """Replace the partitions that ``df`` has rows of, all at once; the others stay."""
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"version={uuid.uuid4().hex}"
    df.write.mode("error").partitionBy(*keys).parquet(f"{path}/{version}")
    files, pattern = _file_system(spark, f"{path}/{version}/" + "/".join(f"{k}=*" for k in keys))
    written = [s.getPath() for s in files.globStatus(pattern) or []]
    new = {}
    for place in written:
        parts = [place.getName()]
        for _ in keys[1:]:
            place = place.getParent()
            parts.insert(0, place.getName())
        new["/".join(parts)] = f"{version}/{'/'.join(parts)}"
    for _ in range(attempts):
        numbers = _numbers(spark, path)
        before = _read(spark, path, numbers[-1]) if numbers else {}
        if _commit(spark, path, (numbers[-1] if numbers else 0) + 1, before | new):
            return
    raise SnapshotConflict(f"no number for a snapshot of {path} after {attempts} attempts")


def read_partitions(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame | None:
    """Rows of the newest snapshot, only of the partitions with the ``wanted`` key values; None without a snapshot.

    Folders of other partitions are not even listed.
    """
    path = path.rstrip("/")
    partitions = current_partitions(spark, path)
    if partitions is None:
        return None
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    parts = {f"{k}={escape(v)}" for k, v in wanted.items()}
    chosen = [f"{path}/{folder}" for name, folder in sorted(partitions.items()) if parts <= set(name.split("/"))]
    if not chosen:
        # The schema of the table, and no row.
        return spark.read.option("basePath", path).parquet(*[f"{path}/{f}" for f in partitions.values()]).limit(0).drop("version")
    return spark.read.option("basePath", path).parquet(*chosen).drop("version")


def remove_old_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all snapshots but the newest ``keep``, and version folders that none of these lists; returns the deleted folders.

    Not while a write is under way: its folder is not listed yet.
    """
    path, numbers = path.rstrip("/"), _numbers(spark, path.rstrip("/"))
    kept = numbers[-keep:]
    listed = {folder.split("/")[0] for n in kept for folder in _read(spark, path, n).values()}
    gone = [n for n in _names(spark, path) if n.startswith("version=") and n not in listed]
    files, _ = _file_system(spark, path)
    for name in [f"{SNAPSHOTS}/{n:012d}.json" for n in numbers[: len(numbers) - len(kept)]] + gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone
