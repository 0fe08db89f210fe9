"""Exact removal of repeated passages with prefix-partitioned suffix trees.

A suffix is a word position of a document, read to a depth of ``window`` words in three
symbols (hashes of consecutive words). Suffixes are dealt out by their first symbol
and sorted; every task cuts its sorted suffixes into groups that fit in memory, at the
shortest prefix (one, two or three symbols) whose change ends a group in time. In a
group the common prefixes of neighbours give the suffix tree, and its internal nodes at
depth ``window`` are the repeats: all their leaves but the first start a window that
occurred earlier.

Two exact reductions come first. Equal texts: every copy after the first loses all its
words if it has a window at all, and only the first one goes on. Anchors: of the
``ANCHOR``-word sequences in a window the one with the smallest hash is its anchor; equal
windows have equal anchors, so a window whose anchor occurs once in the corpus cannot
repeat. Within an Arrow batch equal windows are settled at once, so that a passage
shared by a third of the documents sends one suffix for each batch.

Rows: null and empty texts have no words; rows that repeat a doc_id are told apart by a
stored row number (the order of equal ids); a null id comes before all others; extra columns
are ignored. Words are compared by 64-bit hashes, three of which cover a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import byte_column, mix64
from reviewloom.storage import materialise

ANCHOR = 8
GROUP_SUFFIXES, BATCH_TEXTS = 400_000, 4_096
#: Repeated anchors, and rows of equal texts, up to this number (32 MB) go to every task; more are joined.
BROADCAST_ROWS = 4_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each position."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= STEP
        out += mix64(hashes[j : j + n])
    return mix64(out)


def anchor_places(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every anchor candidate, place of the anchor of every window); the leftmost of equal ones."""
    value = sequences(hashes, ANCHOR)
    width = window - ANCHOR + 1
    n = len(value) - width + 1
    if n <= 0:
        return value, np.zeros(0, np.int64)
    best, place = value[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = value[j : j + n]
        less = other < best
        np.copyto(best, other, where=less)
        place[less] = np.flatnonzero(less) + j
    return value, place


def tree_repeats(symbols: np.ndarray) -> np.ndarray:
    """Indices of the leaves that are not the first below an internal node at full depth.

    Suffixes are sorted by ``symbols`` and then by place in the corpus. The common prefix
    of neighbours, in symbols, is the depth of the tree node that joins them.
    """
    depth = np.zeros(max(0, len(symbols[0]) - 1), np.int8)
    equal = np.ones(len(depth), bool)
    for s in symbols:
        equal &= s[1:] == s[:-1]
        depth += equal
    return np.flatnonzero(depth == len(symbols)) + 1


def groups(batches, most: int):
    """Sorted suffixes as arrays, cut where one, else two, else three symbols change; the part of
    a repeat that is split by a full group keeps its first leaf in front."""
    names = ("s0", "s1", "s2", "rank", "row", "pos")
    held: list[np.ndarray] = []
    for batch in batches:
        part = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in names])
        held.append(part)
        if sum(p.shape[1] for p in held) < most:
            continue
        whole = np.concatenate(held, axis=1)
        cut = 0
        for symbols in (1, 2, 3):
            change = np.flatnonzero((whole[:symbols, 1:] != whole[:symbols, :-1]).any(axis=0))
            if len(change):
                cut = int(change[-1]) + 1
                break
        if cut:
            yield whole[:, :cut]
            held = [whole[:, cut:]]
        else:  # one repeat fills the group: its first leaf stays for the rest
            yield whole
            held = [whole[:, :1]]
    if held:
        yield np.concatenate(held, axis=1)


def repeated_windows(docs: DataFrame, copies: DataFrame, window: int = 20, broadcast_rows: int = BROADCAST_ROWS,
                     group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``row``, ``pos``: starts of windows whose words occurred earlier, in rows that are not ``copies``.

    ``docs``: ``row`` (distinct long), ``rank`` (order of the documents, long) and ``text``;
    ``copies``: ``row`` of the texts that equal an earlier one.
    """
    few_copies = small_set(copies, "row", broadcast_rows)
    if few_copies is None:
        docs = docs.join(copies, "row", "left_anti")
    lengths = (ANCHOR, (window - ANCHOR) // 2, window - ANCHOR - (window - ANCHOR) // 2)

    def anchors(batches):
        for batch in batches:
            found = []
            for data in without(batch, few_copies)[2]:
                hashes = word_hashes(data.split())
                if len(hashes) >= window:
                    value, place = anchor_places(hashes, window)
                    found.append(value[np.unique(place)])
            if found:
                value, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int32))], names=["anchor", "n"])

    counted = docs.select("row", "rank", "text").mapInArrow(anchors, "anchor long, n int")
    repeated = materialise(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")

    def emit(rows, ranks, texts, chosen):
        """Suffix rows of a batch (first of equal windows) and stretches settled here."""
        for a in range(0, len(rows), BATCH_TEXTS):
            yield from emit_part(rows[a : a + BATCH_TEXTS], ranks[a : a + BATCH_TEXTS], texts[a : a + BATCH_TEXTS], chosen)

    def emit_part(rows, ranks, texts, chosen):
        parts = []
        for row, rank, data in zip(rows, ranks, texts, strict=True):
            hashes = word_hashes(data.split())
            if len(hashes) < window:
                continue
            value, place = anchor_places(hashes, window)
            at = np.flatnonzero(chosen(row, value, place))
            if len(at):
                first = sequences(hashes, lengths[0])[at]
                second = sequences(hashes[lengths[0] :], lengths[1])[at]
                third = sequences(hashes[lengths[0] + lengths[1] :], lengths[2])[at]
                parts.append(np.stack([first.view(np.int64), second.view(np.int64), third.view(np.int64), np.full(len(at), rank), np.full(len(at), row), at]))
        if not parts:
            return
        whole = np.concatenate(parts, axis=1)
        parts.clear()
        whole = whole[:, np.lexsort(whole[::-1])]
        late = tree_repeats(whole[:3])
        first = np.ones(whole.shape[1], bool)
        first[late] = False
        yield from suffix_batches(whole[:, first], 0)
        done = whole[:, late]
        # Settled rows only pass through: spread, with nothing to compare.
        done[0] = mix64((done[4] * 31 + done[5]).view(np.uint64)).view(np.int64)
        done[1:4] = 0
        yield from suffix_batches(done, 1)

    def suffix_batches(whole, settled):
        for a in range(0, whole.shape[1], 1 << 16):
            part = whole[:, a : a + (1 << 16)]
            arrays = [pa.array(part[i]) for i in range(5)] + [pa.array(part[5].astype(np.int32)), pa.array(np.full(part.shape[1], settled, np.int8))]
            yield pa.RecordBatch.from_arrays(arrays, names=["s0", "s1", "s2", "rank", "row", "pos", "settled"])

    schema = "s0 long, s1 long, s2 long, rank long, row long, pos int, settled byte"
    known = small_set(repeated, "anchor", broadcast_rows)
    if known is not None:

        def work(batches):
            for batch in batches:

                def chosen(row, value, place):
                    at = np.unique(place)
                    hit = np.zeros(len(value), bool)
                    hit[at] = member(value[at].view(np.int64), known)
                    return hit[place]

                yield from emit(*without(batch, few_copies), chosen)

        suffixes = docs.select("row", "rank", "text").mapInArrow(work, schema)
    else:

        def placed(batches):
            for batch in batches:
                rows, _, texts = without(batch, few_copies)
                for row, data in zip(rows, texts, strict=True):
                    value, place = anchor_places(word_hashes(data.split()), window)
                    at = np.unique(place)
                    arrays = [pa.array(value[at].view(np.int64)), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "row", "at"])

        hits = docs.select("row", "rank", "text").mapInArrow(placed, "anchor long, row long, at int").join(repeated, "anchor")
        hits = hits.groupBy("row").agg(F.collect_list("at").alias("at"))

        def work(batches):
            for batch in batches:
                rows, ranks, places = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "rank", "at"))
                own = dict(zip(rows, places, strict=True))
                yield from emit(rows, ranks, byte_column(batch, "text"), lambda row, value, place: np.isin(place, own[row]))

        suffixes = docs.select("row", "rank", "text").join(hits, "row").mapInArrow(work, schema)

    def late_leaves(batches):
        def unsettled():
            for batch in batches:
                done = batch.column(batch.schema.get_field_index("settled")).to_numpy() == 1
                if done.any():
                    settled.append(batch.filter(pa.array(done)).select(["row", "pos"]))
                yield batch.filter(pa.array(~done))

        settled: list[pa.RecordBatch] = []
        for whole in groups(unsettled(), group_suffixes):
            yield from settled
            settled.clear()
            late = tree_repeats(whole[:3])
            for a in range(0, len(late), 1 << 16):
                part = whole[:, late[a : a + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(part[4]), pa.array(part[5].astype(np.int32))], names=["row", "pos"])
        yield from settled

    order = ["s0", "s1", "s2", "rank", "row", "pos"]
    return suffixes.repartition("s0").sortWithinPartitions(*order).mapInArrow(late_leaves, "row long, pos int")


def small_set(df: DataFrame, column: str, most: int) -> np.ndarray | None:
    """Sorted values of a stored column if there are at most ``most`` (8 bytes each), else None."""
    if df.count() > most:
        return None
    return np.sort(df.select(column).toArrow()[column].to_numpy())


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def without(batch: pa.RecordBatch, copies: np.ndarray | None) -> tuple[list, list, list]:
    """(rows, ranks, texts) of a batch, less the copies."""
    if copies is not None and len(copies):
        own = batch.column(batch.schema.get_field_index("row")).to_numpy()
        batch = batch.filter(pa.array(~member(own, copies)))
    rows, ranks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "rank"))
    return rows, ranks, byte_column(batch, "text")


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row, rank``; the row number is the id, or a stored number where ids repeat or are null."""
    distinct = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0
    own = docs.select("doc_id", "text")
    if distinct:
        own = own.withColumn("row", F.col("doc_id").cast("long"))
    else:
        own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    return own.withColumn("rank", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))


def remove_repeats(docs: DataFrame, window: int = 20, broadcast_rows: int = BROADCAST_ROWS, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) of every row."""
    own = numbered(docs)
    keyed = own.where("text is not null").select(
        F.struct("rank", "row").alias("place"), F.xxhash64("text").alias("k0"), F.xxhash64("text", F.lit(1)).alias("k1"), F.length("text").alias("n")
    )
    firsts = keyed.groupBy("k0", "k1", "n").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1").select("k0", "k1", "n", "first")
    copies = keyed.join(firsts, ["k0", "k1", "n"]).where("place.row <> first.row").select(F.col("place.row").alias("row"))
    copies = materialise(copies, "equal-texts")
    starts = repeated_windows(own, copies, window, broadcast_rows, group_suffixes).groupBy("row").agg(F.collect_list("pos").alias("starts"))
    marks = starts.withColumn("copy", F.lit(False)).unionByName(copies.select("row", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy")))

    def work(batches):
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "starts", "copy")}
            n_words, n_removed, kept = [], [], []
            for data, starts, copy in zip(byte_column(batch, "text"), column["starts"], column["copy"].to_pylist(), strict=True):
                words = data.split()
                drop = np.zeros(len(words) + 1, np.int64)
                if copy and len(words) >= window:
                    drop[0] = 1
                elif starts.is_valid and len(starts):
                    at = starts.values.to_numpy(zero_copy_only=False)
                    drop[at] += 1  # distinct starts, and no two windows end together
                    drop[at + window] -= 1
                gone = np.cumsum(drop[:-1]) > 0
                n_words.append(len(words)), n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not gone.any() else [words[i] for i in np.flatnonzero(~gone).tolist()]))
            arrays = [column["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = own.select("row", "doc_id", "text").join(marks, "row", "left").select("doc_id", "text", "starts", "copy")
    return joined.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
