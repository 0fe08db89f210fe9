"""Alignment of two tokenizers: which ids of one share bytes with which ids of the other.

Every text is encoded by a byte-level BPE (side A, from a leading space on) and by a
sentence-piece BPE (side B, which adds that space itself). An A and a B token are linked
where their byte ranges overlap; byte offsets at which both end cut the text into groups.

Counting how many documents hold a pair linked is external: a task turns texts of about
``CHUNK_BYTES`` into pair-document records, sorted with A as the major side and dealt by
radix (A id modulo ``RADIXES``) into zstd runs of the shared folder. What travels is one
key and one number for each pair and run: runs of a radix meet in key order, a heap merges
them, and as all pairs of an A id stand together, their highest count is known before
the next A id begins; counts are then streamed back to the runs they came from, where the
records lie that were never moved. At most ``FAN_IN`` runs meet in one merge; more of them
are merged in levels, and the counts walk the same levels back. So a pair that is in a third of
all documents costs a merge one number for each run, and a task holds a few blocks of each run.

Both encoders are applied to stretches cut at single spaces between visible characters:
no A token and no B piece holds a space after another character (checked for the
vocabulary of B when it is loaded), so both tokenizers end a token at every such cut, and
a stretch that comes again is looked up.

Rows: texts that are null, empty, or not given back byte by byte by both tokenizers have
no tokens (all numbers zero, ``groups_sha256`` empty). Every row is a document of its own,
repeated or null ids included; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.storage import materialise, scratch_path

FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text a chunk of records is made of, and its most texts.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 1 << 16
RADIXES = 64
#: Runs that meet in one merge, pairs of a block of a run, pairs merged at a time.
FAN_IN, BLOCK, STEP = 1024, 4096, 1 << 18
#: Stretches remembered by a task (up to so many characters each) before it starts anew.
REMEMBERED, LONGEST = 400_000, 200

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of scripts in which two releases of the Unicode tables could class a character differently.
RARE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
# Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the bytes in a byte-level vocabulary: bytes that print stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def spelling(size: int) -> np.ndarray:
    """Decimal digits of every id below ``size``, right-padded with zero bytes, and a place for the separator."""
    return np.array([str(i).encode() for i in range(size)], "S6").view(np.uint8).reshape(size, 6)


def seen_ends(sizes: np.ndarray, total: int) -> np.ndarray:
    """Marks of the byte offsets at which tokens of these sizes end."""
    ends = np.zeros(total + 1, bool)
    ends[np.cumsum(sizes)] = True
    return ends


class Aligner:
    """Both encoders with a memory of stretches; one for each task."""

    def __init__(self, folder: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(f"{folder}/{BYTE_FILE}")
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        known = {piece: i for piece, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in piece)}
        special = {piece: i for piece, i in self.a.get_vocab(with_added_tokens=True).items() if piece not in known}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in known.items() if i not in special.values()}
        self.a_bytes = {i: x for x, i in ranks.items()} | {i: piece.encode() for piece, i in special.items()}
        # The same vocabulary in a faster encoder; its ids are the merge order.
        self.quick = tiktoken.Encoding("quick", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=f"{folder}/{PIECE_FILE}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.digits = spelling(max(len(self.a_size), len(self.b_size)))
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        #: By place: groups spelled; tokens of A, of B, groups, links (tokens -1 if the bytes differ); pairs of the links, end to end.
        self.spelled: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.pairs = np.zeros(0, np.int64)

    def encode_a(self, stretches: list[str]) -> list[list[int]]:
        """Ids of each stretch behind a space; by the vocabulary's own library where the faster one might class a character otherwise."""
        rare = [i for i, s in enumerate(stretches) if len(s) > LONGEST or RARE.search(s)]
        out = [self.quick.encode_ordinary(" " + s) if len(s) <= LONGEST else [] for s in stretches]
        for i, x in zip(rare, self.a.encode_batch([" " + stretches[i] for i in rare], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches not met before, all at once."""
        coded = [self.encode_a(stretches), self.b.encode(stretches, num_threads=1)]
        own = [(" " + s).encode() for s in stretches]
        good = [
            b"".join([self.a_bytes[i] for i in a]) == x == b"".join([self.b_bytes[i] for i in b])
            for x, a, b in zip(own, *coded, strict=True)
        ]
        numbers = np.full((len(own), 4), -1)
        numbers[:, 2:] = 0
        mine = np.flatnonzero(good)
        coded = [[c for c, g in zip(side, good, strict=True) if g] for side in coded]
        numbers[mine, 0], numbers[mine, 1] = ([len(c) for c in side] for side in coded)
        a, b = (np.array([i for c in side for i in c], np.int64) for side in coded)
        last = np.cumsum([len(x) for x, g in zip(own, good, strict=True) if g])
        total = int(last[-1]) if len(last) else 0
        ends_a, ends_b = seen_ends(self.a_size[a], total), seen_ends(self.b_size[b], total)
        count_a, count_b = np.cumsum(ends_a), np.cumsum(ends_b)
        ends, both = np.flatnonzero(ends_a | ends_b), np.flatnonzero(ends_a & ends_b)
        # The token that covers the bytes up to an end is the next one to end there or behind.
        pairs = (a[(count_a - ends_a)[ends]] << 16) | b[(count_b - ends_b)[ends]]
        numbers[mine, 2] = np.diff(np.searchsorted(both, last, "right"), prepend=0)
        numbers[mine, 3] = np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        # Spelled out: the A tokens of a group, then its B tokens, each with the separator behind it.
        in_a, in_b = (np.diff(c[both], prepend=0) for c in (count_a, count_b))
        group_a, group_b = np.repeat(np.arange(len(both)), in_a), np.repeat(np.arange(len(both)), in_b)
        before_b = np.cumsum(in_b) - in_b
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + np.cumsum(in_a)[group_b]
        letters = np.zeros((len(a) + len(b), 6), np.uint8)
        letters[place_a], letters[place_b] = self.digits[a], self.digits[b]
        letters[:, 5] = ord(",")
        letters[place_a[np.cumsum(in_a) - 1], 5] = ord("|")
        letters[place_b[np.cumsum(in_b) - 1], 5] = ord(";")
        text = letters[letters > 0].tobytes().decode()
        width = np.cumsum((letters > 0).sum(axis=1))
        cuts = iter([0, *width[np.cumsum(numbers[mine, 0] + numbers[mine, 1]) - 1].tolist()] if len(mine) else [])
        at = next(cuts, 0)
        first = len(self.spelled)
        for i, g in enumerate(good):
            end = next(cuts) if g else at
            self.spelled.append(text[at : end - 1] if g else "")
            self.place[stretches[i]] = first + i
            at = end
        self.numbers, self.pairs = np.concatenate([self.numbers, numbers]), np.concatenate([self.pairs, pairs])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Numbers of each text, its groups spelled, and the (pair, slot) of every link."""
        if len(self.place) > REMEMBERED:
            self.clear()
        split = [(CUT.split(t) if self.apart else [t]) if t else [] for t in texts]
        new = list(dict.fromkeys([s for own in split for s in own if s not in self.place]))
        if new:
            self.learn(new)
        place = self.place
        places = [[place[s] for s in own] for own in split]
        flat, held = np.array([p for own in places for p in own], np.int64), np.array([len(own) for own in places])
        rows = np.zeros((len(texts), 4), np.int64)
        some = np.flatnonzero(held)
        if len(some):
            starts = (np.cumsum(held) - held)[some]
            rows[some] = np.add.reduceat(self.numbers[flat], starts)
            rows[some[np.minimum.reduceat(self.numbers[flat, 0], starts) < 0]] = 0
        spelled = [";".join([self.spelled[p] for p in own]) if n else "" for own, n in zip(places, rows[:, 0].tolist(), strict=True)]
        slots = np.repeat(np.arange(len(texts)), held)
        flat, slots = flat[rows[slots, 0] > 0], slots[rows[slots, 0] > 0]
        n_links = self.numbers[flat, 3]
        starts = (np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3])[flat]
        links = np.repeat(starts - (np.cumsum(n_links) - n_links), n_links) + np.arange(n_links.sum())
        for s in new:
            if len(s) > LONGEST:  # used once; what was learnt of it goes with the next fresh start
                del place[s]
        return rows, spelled, self.pairs[links], np.repeat(slots, n_links)


def packed(*arrays: np.ndarray) -> bytes:
    """zstd of arrays one after the other, each behind its length and type."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts += [f"{x.dtype.str} {len(x)}\n".encode(), x.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        end = data.index(b"\n", at)
        kind, n = data[at:end].decode().split()
        size = int(n) * np.dtype(kind).itemsize
        out.append(np.frombuffer(data, kind, int(n), end + 1))
        at = end + 1 + size
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    """Rising keys as differences, in the narrowest type."""
    steps = np.diff(keys, prepend=0)
    return steps.astype("<u4") if not len(steps) or steps.max() < 1 << 32 else steps.astype("<u8")


def blocks(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(first key, blob) of a run's blocks."""
    for start in range(0, len(keys), BLOCK):
        part = keys[start : start + BLOCK]
        yield int(part[0]), packed(gaps(part), values[start : start + BLOCK].astype("<i8"))


RUN = "node long, radix int, key long, block binary"


def run_batches(rows: Iterator[tuple[int, int, int, bytes]], size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["node", "radix", "key", "block"])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def encode_chunks(docs: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, radixes: int = RADIXES) -> DataFrame:
    """Rows of three kinds: a document's own numbers (0), a block of a run (1), the records of a chunk (2)."""
    kind = docs.schema["doc_id"].dataType
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = (f"kind int, doc_id {kind.simpleString()}, node long, radix int, key long, block binary, "
              + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string")

    def work(batches):
        import hashlib

        aligner, chunk = Aligner(folder), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= chunk_bytes) and end - start < CHUNK_ROWS:
                    size += len(texts[end] or "")
                    end += 1
                rows, spelled, pairs, slots = aligner.texts(texts[start:end])
                n = len(rows)
                digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in spelled]
                columns = [pa.array([0] * n, pa.int32()), ids.slice(start, n), pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int32()),
                           pa.array(range(n), pa.int64()), pa.nulls(n, pa.binary()),
                           *[pa.array(rows[:, i]) for i in range(4)], pa.array(digest, pa.string())]
                names = ["kind", "doc_id", "node", "radix", "key", "block", *numbers, "groups_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                # One record for each pair and document, in the order radix, A, B, document.
                order = ((pairs >> 16) % radixes << 33) | pairs
                whole, times = np.unique(order * CHUNK_ROWS + slots, return_counts=True)
                pair, slot = np.divmod(whole, CHUNK_ROWS)
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
                held = np.diff(np.r_[first, len(pair)])
                heads = pair[first]
                out = [(2, chunk, 0, 0, packed(held.astype("<u4"), slot.astype("<u2"), times.astype("<u4")))]
                bounds = np.searchsorted(heads, np.arange(radixes + 1) << 33)
                for r in range(radixes):
                    lo, hi = bounds[r], bounds[r + 1]
                    out += [(1, chunk, r, key, blob) for key, blob in blocks(heads[lo:hi] & ((1 << 33) - 1), held[lo:hi])]
                m = len(out)
                columns = [pa.array([o[0] for o in out], pa.int32()), pa.nulls(m, ids.type), pa.array([o[1] for o in out], pa.int64()),
                           pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.binary()),
                           *[pa.nulls(m, pa.int64()) for _ in numbers], pa.nulls(m, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start, chunk = end, chunk + 1

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


class Merge:
    """One k-way merge: open blocks in a heap by their next key, taken up to a bound at a time.

    ``given`` blocks carry final values of the keys (a merge on the way back); without
    them the values are the sums over all runs. ``final`` turns sums into what goes back:
    the count twice, plus one if it is the highest of its A id.
    """

    def __init__(self, final: bool, back: bool):
        self.final, self.back = final, back
        self.heap: list[tuple[int, int, object, np.ndarray, np.ndarray]] = []
        self.count = self.turn = 0

    def add(self, run, keys: np.ndarray, values: np.ndarray) -> None:
        heapq.heappush(self.heap, (int(keys[0]), self.turn, run, keys, values))
        self.turn += 1
        self.count += len(keys)

    def until(self, bound: int | None) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """(run, keys, values) of the keys below ``bound`` (all if None); run None is the merged run itself."""
        parts = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, _, run, keys, values = heapq.heappop(self.heap)
            cut = len(keys) if bound is None else int(np.searchsorted(keys, bound))
            parts.append((run, keys[:cut], values[:cut]))
            self.count -= len(keys)
            if cut < len(keys):
                self.add(run, keys[cut:], values[cut:])
        if not parts:
            return
        source = [p for p in parts if p[0] is None] if any(p[0] is None for p in parts) else parts
        keys, place = np.unique(np.concatenate([p[1] for p in source]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, np.concatenate([p[2] for p in source]))
        if self.final:
            side = keys >> 16
            starts = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
            best = np.repeat(np.maximum.reduceat(sums, starts), np.diff(np.r_[starts, len(keys)]))
            sums = sums * 2 + (sums == best)
        if not self.back:
            yield None, keys, sums
            return
        by_run: dict[object, list[np.ndarray]] = {}
        for run, own, _ in parts:
            if run is not None:
                by_run.setdefault(run, []).append(own)
        for run, own in by_run.items():
            own = np.concatenate(own)
            yield run, own, sums[np.searchsorted(keys, own)]


def merged(runs: DataFrame, final: bool, back: bool, step: int = STEP) -> DataFrame:
    """Merge the blocks of every (parent, radix), which arrive in the order of their first keys.

    ``runs`` has the columns of ``RUN`` and ``parent``; on a way back, blocks with a null
    ``node`` are the parent's own final values.
    """

    def work(batches):
        def rows():
            group, merge = None, None

            def out(found):
                for run, keys, values in found:
                    node = group[0] if run is None else run
                    for key, blob in blocks(keys, values):
                        yield node, group[1], key, blob

            for batch in batches:
                for parent, node, radix, key, blob in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                    if group != (parent, radix):
                        if merge:
                            yield from out(merge.until(None))
                        group, merge = (parent, radix), Merge(final, back)
                    elif merge.count > step:
                        # All pairs of an A id leave together.
                        yield from out(merge.until(key >> 16 << 16))
                    steps, values = unpacked(blob)
                    merge.add(node, np.cumsum(steps.astype(np.int64)), values)
            if merge:
                yield from out(merge.until(None))

        yield from run_batches(rows())

    n = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.select("parent", "node", "radix", "key", "block").repartition(n, "parent", "radix")
    # A parent's own values come before the runs that wait for them.
    dealt = dealt.sortWithinPartitions("parent", "radix", "key", F.col("node").asc_nulls_first())
    return dealt.mapInArrow(work, RUN)


def count_pairs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN, step: int = STEP) -> DataFrame:
    """(node, radix, key, block): the final values of every run's pairs, in blocks by key."""
    levels, sizes = [runs], []
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        sizes.append(n_runs)
        grouped = levels[-1].withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(n_runs)))
        levels.append(materialise(merged(grouped, False, False, step), "alignment-level"))
    found = merged(levels[-1].withColumn("parent", F.lit(0).cast("long")), True, True, step)
    for level, size in zip(levels[-2::-1], sizes[::-1], strict=True):
        given = materialise(found, "alignment-values").select(F.col("node").alias("parent"), F.lit(None).cast("long").alias("node"), "radix", "key", "block")
        waiting = level.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(size))).select("parent", "node", "radix", "key", "block")
        found = merged(given.unionByName(waiting), False, True, step)
    return found


def contributions(bodies: DataFrame, values: DataFrame) -> DataFrame:
    """(node, slot, n_best, count_sum) of every document that has links."""
    back = values.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("radix", "key", "block"))).alias("back"))
    joined = bodies.select("node", "block").join(back, "node").select("node", "block", F.col("back.block").alias("back"))

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, slot, times = unpacked(batch.column(1)[i].as_py())
                final = np.concatenate([unpacked(b)[1] for b in batch.column(2)[i].as_py()])
                each, times = np.repeat(final, held), times.astype(np.int64)
                order = np.argsort(slot, kind="stable")
                slot, each, times = slot[order], each[order], times[order]
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                best, total = np.add.reduceat(times * (each & 1), starts), np.add.reduceat(times * (each >> 1), starts)
                node = pa.array(np.full(len(starts), batch.column(0)[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([node, *[pa.array(x.astype(np.int64)) for x in (slot[starts], best, total)]], names=["node", "slot", "n_best", "count_sum"])

    return joined.mapInArrow(work, "node long, slot long, n_best long, count_sum long")


def align_tokenizers(
    docs: DataFrame, folder: str = FOLDER, chunk_bytes: int = CHUNK_BYTES, radixes: int = RADIXES, fan_in: int = FAN_IN, step: int = STEP
) -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``n_best`` counts links whose pair has the highest document count of its A id, ties
    included; ``count_sum`` adds up the document counts over all links.
    """
    spark = docs.sparkSession
    stored = materialise(encode_chunks(docs, folder, chunk_bytes, radixes), "alignment", scratch_path(spark, "alignment"))
    bodies = stored.where("kind = 2")
    runs = stored.where("kind = 1").select("node", "radix", "key", "block")
    found = contributions(bodies, count_pairs(runs, bodies.count(), fan_in, step))
    own = stored.where("kind = 0").select("doc_id", "node", F.col("key").alias("slot"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return own.join(found, ["node", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
