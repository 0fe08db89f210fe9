"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

Texts are lower-cased (A-Z) and their white space collapsed. Benchmark items are cut
into overlapping patterns of ``length`` characters, so that a part of an item is found
too. A pattern of m characters within e edits of a piece of text shares at least
m + 1 - q - e*q q-grams with it, all within e + 1 neighbouring diagonals (text position
minus pattern position); bands are twice that wide and overlap by half. Bands reaching
the bound are verified by banded alignment: edit distance of the whole pattern to
the best piece of text inside the band.

A cheaper test comes first: only stretches of text in which enough q-grams belong to
any pattern are looked up pattern by pattern; it is implied by the bound.

Rows: null and empty texts and items match nothing; items shorter than q characters
match by equality of their characters anywhere in a text; repeated rows and items are
reported as often as they occur; extra columns are ignored; a null id is reported as null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewloom.llm.common import byte_column

TABLE_BITS = 22
CHUNK = 1 << 20
SHIFT = 1 << 22  # keeps diagonals positive
BLOCK_CHARACTERS = 4_000_000


def normal(data: bytes) -> np.ndarray:
    """Code points of the lower-cased text with single spaces."""
    text = b" ".join(data.lower().split()).decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of the q characters that start at each position."""
    out = np.zeros(max(0, len(codes) - q + 1), np.uint32)
    for j in range(q):
        out *= np.uint32(0x9E3779B1)
        out += codes[j : j + len(out)]
    return out ^ (out >> np.uint32(15))


@dataclass
class Patterns:
    """Patterns of one block of items; ``gram``/``pattern``/``offset`` are sorted by gram."""

    item: list
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray
    pattern: np.ndarray
    offset: np.ndarray
    known: np.ndarray
    short: list
    q: int
    window: int
    least: int


def build(items: list[tuple], q: int = 8, length: int = 96, rate: float = 0.08) -> list[Patterns]:
    """Patterns of (item_id, text) rows; edits allowed: ``rate`` of the characters, fewer where the bound would vanish.

    Whole patterns and those of items shorter than one are kept apart: each set has its own
    filter, whose bound is that of its shortest pattern.
    """
    item, codes, short = [], [], []
    for item_id, text in items:
        whole = normal((text or "").encode())
        if 0 < len(whole) < q:
            short.append((item_id, whole))
            continue
        if not len(whole):
            continue
        ends = list(range(length, len(whole), length // 2)) + [len(whole)]
        for end in ends:
            begin = max(0, end - length)
            item.append(item_id), codes.append(whole[begin:end])
    sets = []
    for whole in (True, False):
        own = [i for i, c in enumerate(codes) if (len(c) == length) == whole]
        if own:
            sets.append(index([item[i] for i in own], [codes[i] for i in own], q, rate))
    if short:
        sets.append(Patterns([], [], *[np.zeros(0, np.int64)] * 5, np.zeros(0, bool), short, q, 1, 1))
    return sets


def index(item: list, codes: list[np.ndarray], q: int, rate: float) -> Patterns:
    m = np.array([len(c) for c in codes])
    edits = np.minimum((rate * m).astype(int), (m - q) // q)
    bound = m + 1 - q - q * edits
    all_grams = [grams(c, q) for c in codes]
    gram = np.concatenate(all_grams)
    pattern = np.repeat(np.arange(len(codes)), [len(g) for g in all_grams])
    offset = np.concatenate([np.arange(len(g)) for g in all_grams])
    order = np.argsort(gram, kind="stable")
    known = np.zeros(1 << TABLE_BITS, bool)
    known[gram >> np.uint32(32 - TABLE_BITS)] = True
    # A match of m characters covers at most m + e of text: a window that long from its
    # start holds all shared q-grams, whatever the pattern.
    window, least = int((m + edits).max()), int(bound.min())
    return Patterns(item, codes, edits, bound, gram[order], pattern[order], offset[order], known, [], q, window, max(1, least))


def candidates(codes: np.ndarray, p: Patterns) -> list[tuple[int, int, int]]:
    """(pattern, lowest diagonal, width) of the bands that reach the q-gram bound."""
    gram = grams(codes, p.q)
    if not len(gram) or not len(p.gram):
        return []
    hit = p.known[gram >> np.uint32(32 - TABLE_BITS)]
    total = np.concatenate(([0], np.cumsum(hit)))
    ends = np.minimum(np.arange(len(gram)) + p.window, len(gram))
    dense = np.flatnonzero(total[ends] - total[: len(gram)] >= p.least)
    if not len(dense):
        return []
    # Positions inside any dense window.
    change = np.zeros(len(gram) + 1, np.int64)
    np.add.at(change, dense, 1)
    np.add.at(change, np.minimum(dense + p.window, len(gram)), -1)
    at = np.flatnonzero((np.cumsum(change[:-1]) > 0) & hit)
    low, high = np.searchsorted(p.gram, gram[at], "left"), np.searchsorted(p.gram, gram[at], "right")
    n = high - low
    if not n.sum():
        return []
    row = np.repeat(at, n)
    entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    pattern = p.pattern[entry]
    diagonal = row - p.offset[entry]
    cell = (diagonal + SHIFT) // (p.edits[pattern] + 1)
    # A q-gram of the pattern counts once in each cell, half a band wide.
    key = np.sort((pattern << 40) | (cell << 12) | p.offset[entry])
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] >> 12
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, count = key[first], np.diff(np.concatenate((first, [len(key)])))
    # Two neighbouring cells are a band.
    after = np.where(np.concatenate((key[1:] == key[:-1] + 1, [False])), np.concatenate((count[1:], [0])), 0)
    reached = np.flatnonzero(count + after >= p.bound[key >> 28])
    found = [(int(k) >> 28, int(k) & ((1 << 28) - 1)) for k in key[reached]]
    return [(a, b * int(p.edits[a] + 1) - SHIFT, 2 * int(p.edits[a] + 1)) for a, b in found]


def align(codes: np.ndarray, pattern: np.ndarray, low: int, width: int, edits: int) -> tuple[int, int] | None:
    """(edits, end in text) of the best alignment inside diagonals [low - edits, low + width + edits).

    The whole pattern is used, the text may begin and end anywhere in the band.
    """
    m = len(pattern)
    for d in range(max(low, 0), min(low + width, len(codes) - m + 1)):
        if codes[d] == pattern[0] and codes[d + m - 1] == pattern[-1] and (codes[d : d + m] == pattern).all():
            return 0, d + m  # an exact copy needs no table
    first, size = low - edits, width + 2 * edits
    far = m + 1
    row = np.where((first + np.arange(size) >= 0) & (first + np.arange(size) <= len(codes)), 0, far)
    step = np.arange(size)
    for i, c in enumerate(pattern):
        at = first + i + step  # text position matched with c on each diagonal
        inside = (at >= 0) & (at < len(codes))
        same = np.zeros(size, bool)
        same[inside] = codes[at[inside]] == c
        skip = np.concatenate((row[1:], [far])) + 1  # c is not in the text
        best = np.minimum(np.where(inside, row + ~same, far), np.where(at + 1 >= 0, skip, far))
        # Text characters that are not in the pattern: running minimum along the row.
        best = np.minimum.accumulate(best - step) + step
        row = np.minimum(best, far)
        if row.min() > edits:
            return None
    k = int(row.argmin())
    return (int(row[k]), first + len(pattern) + k) if row[k] <= edits else None


def matches(codes: np.ndarray, sets: list[Patterns]) -> list[tuple]:
    """(item, begin in text, end in text, edits, patterns matched) of every item found in a text."""
    out: dict = {}
    for p in sets:
        found: dict = {}
        overlap = 4 * p.window
        for start in range(0, max(1, len(codes)) if p.codes else 0, CHUNK):
            part = codes[start : start + CHUNK + overlap]
            for a, low, width in candidates(part, p):
                hit = align(part, p.codes[a], low, width, int(p.edits[a]))
                if hit:
                    end = start + hit[1]
                    place = (a, end // len(p.codes[a]))
                    found[place] = min(found.get(place, (hit[0], end)), (hit[0], end))
        for (a, _), (distance, end) in sorted(found.items()):
            begin = max(0, end - len(p.codes[a]))
            item = out.setdefault(p.item[a], [begin, end, distance, set()])
            item[0], item[1] = min(item[0], begin), max(item[1], end)
            item[2] = min(item[2], distance)
            item[3].add(a)
        for item_id, whole in p.short:
            size = len(whole)
            if len(codes) >= size:
                at = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(codes, size) == whole).all(axis=1))
                if len(at):
                    out.setdefault(item_id, [int(at[0]), int(at[0]) + size, 0, {0}])
    return [(k, v[0], v[1], v[2], len(v[3])) for k, v in out.items()]


def pattern_blocks(benchmark: DataFrame, **settings):
    """Patterns of the benchmark, at most about ``BLOCK_CHARACTERS`` characters at a time."""
    own = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_CHARACTERS
    for i in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()
        patterns = build(sorted(((r[0], r[1]) for r in rows), key=str), **settings)
        if patterns:
            yield patterns


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``doc_id``, ``item_id``, ``begin``, ``end``, ``edits``, ``patterns``: one row for each item found in a text.

    Positions count characters of the normalised text. Texts meet the benchmark in blocks
    of bounded size, one scan for each block (one for all usual benchmarks).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item_kind)
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, begin long, end long, edits int, patterns int"

    def scan(patterns: list[Patterns]):
        def work(batches):
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                rows, source = [], []
                for i, data in enumerate(byte_column(batch, "text")):
                    for hit in matches(normal(data), patterns):
                        rows.append(hit), source.append(i)
                if rows:
                    item, begin, end, edits, count = zip(*rows, strict=True)
                    arrays = [ids.take(pa.array(source)), pa.array(item, item_type), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()), pa.array(count, pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "begin", "end", "edits", "patterns"])

        return docs.select("doc_id", "text").mapInArrow(work, schema)

    found = None
    for patterns in pattern_blocks(benchmark, **settings):
        found = scan(patterns) if found is None else found.union(scan(patterns))
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no benchmark item."""

    def scan(df: DataFrame, patterns: list[Patterns]) -> DataFrame:
        def work(batches):
            for batch in batches:
                clean = [not matches(normal(data), patterns) for data in byte_column(batch, "text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return df.mapInArrow(work, df.schema)

    for patterns in pattern_blocks(benchmark, **settings):
        docs = scan(docs, patterns)
    return docs
