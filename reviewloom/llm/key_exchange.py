"""Sums over 56-bit keys that many chunks of the corpus hold, and their way back to these chunks.

A chunk sends each of its distinct keys once, in blocks of rising keys (differences and numbers as byte planes under
zstd, about five bytes a key), dealt by key space and the top bits of the key. A merge opens
the blocks of its runs in key order, adds up what equal keys carry and answers every run, block by
block, so that a chunk reads its answers in the order of its own keys and no key travels back. With more
than ``fan_in`` runs, runs are merged in levels and the answers walk the same levels back; a task then
holds a few blocks of each of at most about ``fan_in`` runs. A key that all chunks hold costs one entry of
each run, and no row of the corpus moves.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.storage import materialise

RUN = "node long, space byte, radix int, key long, block binary"
KEY_BITS, RADIX_BITS, BLOCK = 56, 6, 2048
FAN_IN, STEP = 1024, 1 << 17
HEAD = "<IBB"  # rows, width, with keys


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind)


def pack_block(keys: np.ndarray | None, values: np.ndarray) -> bytes:
    """(n, width) whole numbers from zero on, with or without their rising keys (the first one is kept outside)."""
    n, width = values.shape
    body = b"".join(_planes(values[:, i].astype("<u8")) for i in range(width))
    if keys is not None:
        body = _planes(np.diff(keys, prepend=keys[:1]).astype("<i8")) + body
    return struct.pack(HEAD, n, width, keys is not None) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_block(key: int, blob: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    n, width, keyed = struct.unpack_from(HEAD, blob)
    body = zstandard.ZstdDecompressor().decompress(blob[struct.calcsize(HEAD) :])
    columns = [_from_planes(body[8 * n * i : 8 * n * (i + 1)], n, "<i8").ravel() for i in range(keyed + width)]
    return (key + np.cumsum(columns[0]) if keyed else None), np.stack(columns[keyed:], axis=1)


def _blocks(node, space: int, radix: int, keys: np.ndarray, values: np.ndarray, keyed: bool) -> Iterator[tuple]:
    for start in range(0, len(keys), BLOCK):
        part = keys[start : start + BLOCK]
        yield node, space, radix, int(part[0]), pack_block(part if keyed else None, values[start : start + BLOCK])


def run_rows(node: int, space: int, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
    """Rows of ``RUN`` for the rising distinct ``keys`` (below 2 ** KEY_BITS) of a chunk and their (n, width) ``values``."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << RADIX_BITS, dtype=np.int64) << KEY_BITS - RADIX_BITS)
    for radix, (lo, hi) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)):
        yield from _blocks(node, space, radix, keys[lo:hi], values[lo:hi], True)


def batches_of(rows: Iterator[tuple], size: int = 256) -> Iterator[pa.RecordBatch]:
    types, held = (pa.int64(), pa.int8(), pa.int32(), pa.int64(), pa.binary()), []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["node", "space", "radix", "key", "block"])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


class _Merge:
    """Open blocks in a heap by their next key; ``take`` consumes all keys below a bound."""

    def __init__(self):
        self.heap: list[tuple[int, int, object, np.ndarray, np.ndarray]] = []
        self.count = self.left = self.turn = 0

    def full(self, step: int) -> bool:
        """Whether enough has come in since the last time to take some: open blocks stay open anyway."""
        return self.count > max(step, 2 * self.left)

    def add(self, run, keys: np.ndarray, values: np.ndarray) -> None:
        heapq.heappush(self.heap, (int(keys[0]), self.turn, run, keys, values))
        self.turn += 1
        self.count += len(keys)

    def take(self, bound: int | None) -> list[tuple[object, np.ndarray, np.ndarray]]:
        parts = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, _, run, keys, values = heapq.heappop(self.heap)
            cut = len(keys) if bound is None else int(np.searchsorted(keys, bound))
            parts.append((run, keys[:cut], values[:cut]))
            self.count -= len(keys)
            if cut < len(keys):
                self.add(run, keys[cut:], values[cut:])
        self.left = self.count
        return parts


def _added(place: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Column sums by place; whole numbers, exact below 2 ** 53."""
    return np.stack([np.bincount(place, numbers[:, i], n) for i in range(numbers.shape[1])], axis=1).astype(np.int64)


def _answers(parts, finish: Callable | None, space: int) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(run, keys, answers) of every run; the last column says whether the run is the one that owns the key."""
    given = [p for p in parts if p[0] is None]
    waiting = [p for p in parts if p[0] is not None]
    every = np.concatenate([p[1] for p in waiting])
    keys, first, place = np.unique(every, return_index=True, return_inverse=True)
    if given:
        order = np.argsort(known := np.concatenate([p[1] for p in given]), kind="stable")
        answer = np.concatenate([p[2] for p in given])[order[np.searchsorted(known[order], keys)]]
        answer, owned = answer[:, :-1], answer[:, -1]
    else:
        sums = _added(place, np.concatenate([p[2] for p in waiting]), len(keys))
        answer, owned = finish(space, sums), np.ones(len(keys), np.int64)
    owner = np.zeros(len(every), np.int64)
    owner[first] = owned
    by_run: dict[object, list[tuple]] = {}
    at = 0
    for run, own, _ in waiting:
        to = slice(at, at + len(own))
        by_run.setdefault(run, []).append((own, np.column_stack([answer[place[to]], owner[to]])))
        at += len(own)
    for run, held in by_run.items():
        yield run, np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])


def _sums(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    return keys, _added(place, np.concatenate([p[2] for p in parts]), len(keys))


def _merged(runs: DataFrame, finish: Callable | None, up: bool, keyed: bool, step: int) -> DataFrame:
    """Merge the runs of every (parent, space, radix): upwards into one run each, or answers to all runs."""

    def work(batches):
        def rows():
            group, merge = None, None

            def out(parts):
                if not parts:
                    return
                parent, space, radix = group
                if up:
                    yield from _blocks(parent, space, radix, *_sums(parts), True)
                    return
                for run, keys, values in _answers(parts, finish, space):
                    yield from _blocks(run, space, radix, keys, values, keyed)

            for batch in batches:
                for parent, node, space, radix, key, blob in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                    if group != (parent, space, radix):
                        if merge:
                            yield from out(merge.take(None))
                        group, merge = (parent, space, radix), _Merge()
                    elif merge.full(step):
                        yield from out(merge.take(key))
                    merge.add(node, *unpack_block(key, blob))
            if merge:
                yield from out(merge.take(None))

        yield from batches_of(rows())

    n = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = ["parent", "node", "space", "radix", "key", "block"]
    dealt = runs.select(*columns).repartition(n, "parent", "space", "radix")
    # A parent's own answers come before the runs that wait for them.
    dealt = dealt.sortWithinPartitions("parent", "space", "radix", "key", F.col("node").asc_nulls_first())
    return dealt.mapInArrow(work, RUN)


def exchange(runs: DataFrame, n_runs: int, finish: Callable[[int, np.ndarray], np.ndarray], purpose: str, fan_in: int = FAN_IN, step: int = STEP) -> DataFrame:
    """Answers to all runs, stored: ``finish(space, sums)`` for each key, then whether this run owns the key (one does). Whole numbers from zero on."""
    if n_runs <= fan_in:
        found = _merged(runs.withColumn("parent", F.lit(0).cast("long")), finish, False, False, step)
        return materialise(found, purpose)
    runs = materialise(runs, f"{purpose}-runs")
    levels, sizes = [runs], []
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        sizes.append(n_runs)
        grouped = levels[-1].withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(n_runs)))
        levels.append(materialise(_merged(grouped, None, True, True, step), f"{purpose}-level"))
    found = _merged(levels[-1].withColumn("parent", F.lit(0).cast("long")), finish, False, True, step)
    for depth, (level, size) in enumerate(zip(levels[-2::-1], sizes[::-1], strict=True)):
        given = materialise(found, f"{purpose}-answers").withColumn("parent", F.col("node")).withColumn("node", F.lit(None).cast("long"))
        waiting = level.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(size)))
        found = _merged(given.unionByName(waiting), None, False, depth < len(sizes) - 1, step)
    return materialise(found, purpose)


def by_chunk(answers: DataFrame, name: str) -> DataFrame:
    """``node`` and ``name``: the answers of each chunk in the order of its keys, as array of (space, radix, key, block)."""
    return answers.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("space", "radix", "key", "block"))).alias(name))


def answer_arrays(blocks: list[dict] | None) -> dict[int, np.ndarray]:
    """(n, width) answers by key space, from one value of ``by_chunk``."""
    held: dict[int, list[np.ndarray]] = {}
    for b in blocks or ():
        held.setdefault(b["space"], []).append(unpack_block(0, b["block"])[1])
    return {space: np.concatenate(parts) for space, parts in held.items()}
