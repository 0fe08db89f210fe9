"""Labelled folders: one small file for each row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def write_text_files(rows: DataFrame, root: str, folders: Sequence[str]) -> None:
    """A file ``root/<folder>/<task>-<number>.txt`` for each row (folder, text), ended by a line break; null is an empty line.

    One pass for all folders, through a file system that Arrow knows: Spark's text sink takes a job for each folder, and its
    driver moves the files one by one. Names follow from the place of a row, so a task that runs again writes the same files;
    ``rows`` should be a stored table. All ``folders`` exist afterwards, also empty ones.
    """
    files, top = _file_system(root)
    for folder in folders:
        files.create_dir(f"{top}/{folder}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _file_system(root)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for folder, text in zip(batch.column("folder").to_pylist(), texts, strict=True):
                with files.open_output_stream(f"{top}/{folder}/{task:05d}-{n}.txt") as out:
                    out.write((text.as_py() or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    known = rows.select("folder", "text").where(rows["folder"].isin(*folders))
    known.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
