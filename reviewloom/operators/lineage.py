"""Which stored splits a frame reads, from its plan."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame


class ForbiddenSplit(ValueError):
    """A frame reads a split it must not see."""


def _leaves(plan) -> Iterator:
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "InMemoryTableScanExec":
            yield from _leaves(leaf.relation().cachedPlan())
        else:
            yield leaf


def splits_read(df: DataFrame, column: str = "split") -> set[str]:
    """Values of the partition column ``split=...`` in the files the frame's scans are left with after partition pruning.

    Found from folder names and partition values; no data is read. A table stored
    without that column in its path has no split.
    """
    found = set()
    for scan in _leaves(df._jdf.queryExecution().sparkPlan()):
        if scan.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        location = scan.relation().location()
        names = list(scan.relation().partitionSchema().fieldNames())
        parts = location.listFiles(scan.partitionFilters(), scan.dataFilters())
        if column in names:
            found |= {str(parts.apply(i).values().getUTF8String(names.index(column))) for i in range(parts.size())}
            continue
        roots = location.rootPaths()
        if not any(parts.apply(i).files().size() for i in range(parts.size())):
            continue
        for i in range(roots.size()):
            for part in roots.apply(i).toString().split("/"):
                if part.startswith(f"{column}="):
                    found.add(unquote(part.split("=", 1)[1]))
    return found


def refuse_split(frames: dict[str, DataFrame], forbidden: str = "test") -> None:
    """Raise if one of the named frames reads the forbidden split."""
    for name, frame in frames.items():
        if forbidden in splits_read(frame):
            raise ForbiddenSplit(f"{name} reads the split {forbidden!r}, which is for one measurement at the end")
