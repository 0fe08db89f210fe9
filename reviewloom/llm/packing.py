"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its number of words (white-space separated) plus one end token.
Longer documents than the largest permitted sequence are cut into full sequences and a
rest. Pieces are dealt to shards of about ``shard_pieces`` by a hash of row and piece,
and each shard is packed by itself, longest piece first: into the open bin with the
smallest sufficient room whatever its size (of equal ones, that which was filled last), or else into a new bin. Its size is the one with the least
price per token it would really hold: each permitted size is filled on trial with the pieces still
waiting, always the longest that fits, so a larger size wins where the smaller ones would stay half empty. Last,
every bin shrinks to the smallest permitted size that holds its contents.

Rows: null and empty texts have the end token only; repeated rows and null ids are
packed like any other row; extra columns are ignored. All pieces of all rows are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import byte_column
from reviewloom.storage import materialise

SIZES = (512, 1024, 2048, 4096)
SHARD_PIECES = 10_000


def price(size: int, largest: int) -> float:
    """Cost of a sequence: its tokens, attention growing with the square, and a fixed part."""
    return 16 + size * (1 + size / (4 * largest))


def trial_fill(length: int, size: int, waiting: dict[int, int], present: int) -> int:
    """Tokens a new bin of ``size`` would hold: the piece in hand, then always the longest waiting piece that fits.

    ``present`` has bit r set if a piece of length r is waiting, ``waiting`` how many.
    """
    room, taken = size - length, 0
    last = 0
    while fitting := present & ((1 << (room + 1)) - 1):
        longest = fitting.bit_length() - 1
        taken = taken + 1 if longest == last else 1
        last = longest
        if taken > waiting[longest]:
            # All of this length are in the bin; shorter ones may still fit.
            present &= (1 << longest) - 1
            continue
        room -= longest
    return size - room


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every length, (size, used) of every bin; lengths in descending order, none above the largest size."""
    sizes = tuple(sorted(sizes))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened: list[int] = []
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    waiting = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    present = sum(1 << n for n in waiting)
    for i, length in enumerate(lengths.tolist()):
        waiting[length] -= 1
        if not waiting[length]:
            present &= ~(1 << length)
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            usable = [c for c in sizes if c >= length]
            size = min(usable, key=lambda c: (price(c, sizes[-1]) / trial_fill(length, c, waiting, present), c))
            b, room = len(opened), size
            opened.append(size), used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        if room > length:
            by_room.setdefault(room - length, []).append(b)
            rooms |= 1 << (room - length)
    total = np.array(used, np.int64)
    final = np.array(sizes)[np.searchsorted(sizes, total)] if len(total) else total
    return bins, offsets, final, total


def token_counts(docs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            counts = [len(x.split()) + 1 for x in byte_column(batch, "text")]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long")


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece: ``doc_id, row_id, piece, start, length`` (tokens of the document)
    and ``shard, bin, bin_size, bin_used, offset`` (its place)."""
    largest = max(sizes)
    # The row number is stored with the counts, so that retried tasks see the same one.
    counted = materialise(token_counts(docs).withColumn("row_id", F.monotonically_increasing_id()), "packing-counts")
    pieces_of = F.ceil(F.col("n_tokens") / largest)
    total = counted.agg(F.sum(pieces_of)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    pieces = counted.select("doc_id", "row_id", "n_tokens", F.explode(F.sequence(F.lit(0), (pieces_of - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * largest
    pieces = pieces.select(
        "doc_id", "row_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n_tokens") - start).alias("length"),
        F.pmod(F.xxhash64("row_id", "piece"), F.lit(shards)).cast("int").alias("shard"),
    )

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, size, used = pack(frame["length"].to_numpy(), sizes)
        return frame.assign(bin=bins, bin_size=size[bins], bin_used=used[bins], offset=offsets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, row_id long, piece int, start long, length long, shard int, bin long, bin_size long, bin_used long, offset long")
    return pieces.groupBy("shard").applyInPandas(lambda frame: work(frame)[schema_names(schema)], schema)


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
