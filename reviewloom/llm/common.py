"""Helpers of the operators: tokens, Arrow columns, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.storage import materialise

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit value whose bit is one where over half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        # One byte for each bit; eight of them are added at once, at most 255 rows before they could overflow.
        lanes = np.unpackbits(part, axis=1).view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def bucket_bit(doc_id="doc_id", modulus: int = 4):
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``edges`` holds two long columns ``a`` and ``b``; null ends and loops are left
    out. Rounds of large-star and small-star (each node's links move to its smallest
    neighbour) run until nothing changes; only minima per node and distinct links are
    shuffled, and every round is written to the shared folder, so no node's whole
    neighbourhood is gathered in one task. Returns ``node``, ``root``.
    """

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, purpose)
    before = signature(links)
    while before[0]:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, purpose)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        links = materialise(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), purpose)
        after = signature(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Forest:
    """Links of one task that join nodes not yet joined here; the rest is implied."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        new = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                new.append((x, y))
        return new


def runs(batches, key_columns: tuple[str, ...], rows: int = 1 << 18):
    """Join sorted Arrow batches into tables of about ``rows`` rows that end where the key changes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(whole.num_rows - 1, bool)
        for name in key_columns:
            values = whole[name].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            continue
        cut = int(cuts[-1]) + 1
        yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        count = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
