"""Language-model scores from a weighted backoff automaton over word n-grams.

Counts. Every word of the training documents is counted, and so is the end token; every pair and triple that
occurs at least ``least`` times is an arc. A triple is counted only where both of its pairs are arcs, which
loses none, as a triple is never more frequent than its pairs.

Automaton. A state is an n-gram of up to two words that is known, or the empty history. It has an arc
for each kept continuation, with the discounted probability; its failure arc leads to
its longest proper suffix and weighs the mass left over, so that probabilities
add up to one. The empty state knows every word: (count + 1) / (N + V + 1).

Scores. A text is read once from left to right: the state in hand either has an arc for the next word, or its
failure arc is paid and followed until one has. Tasks never hold the automaton but the part of
it that their texts can touch. Texts are stored as chunks of word numbers; a chunk asks for its own distinct
n-grams (see ``key_exchange``): first for the counts of words and pairs, then of triples between kept pairs, and last
for what the arcs of its states give out. That is added up in the same exchange as whole numbers: each n-gram
is owned by one of the chunks that hold it, which contributes its counts to the n-gram's history. A chunk does not ask
about a history that occurs less than ``least`` times elsewhere: it holds all of its arcs itself.
Chunks lie in buckets by number, so the three returns meet them without moving them.

Rows: null texts are empty, an empty text has the end token; held-out and null-id
rows are scored but not learned from; repeated rows count as often as they occur; with
no training row every word is unknown. Extra columns are ignored. Words and n-grams are
compared by 56-bit hash.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import bucket_bit, byte_column, mix64
from reviewloom.llm.key_exchange import FAN_IN, KEY_BITS, RUN, STEP, answer_arrays, batches_of, by_chunk, exchange, run_rows
from reviewloom.storage import materialise, scratch_path

HASH = np.uint64((1 << KEY_BITS) - 1)
END = np.int64(0x5EED0FEED0FEED)  # hash value that stands for the end token
DISCOUNT = 0.5
LEAST = 1e-12  # mass left over where all has been given out
#: Bytes of text of a chunk (a longer text is one by itself), and its most texts.
CHUNK_BYTES, CHUNK_ROWS = 5 << 20, 1 << 16
#: Key spaces of the exchanges: one number of the whole corpus, words, pairs, triples.
WHOLE, WORDS, PAIRS, TRIPLES = range(4)
#: Kinds of states, and the weight (of no probability) of an arc that is not there.
EMPTY, WORD, PAIR = range(3)
NO_ARC = 1.0


def hashed(data: bytes) -> np.ndarray:
    """Hashes of the lower-cased words and the end token."""
    words = data.lower().split()
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & HASH).view(np.int64)
    out[-1] = END
    return out


def gram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their first and last parts (words of a pair, pairs of a triple)."""
    left, right = left.view(np.uint64), right.view(np.uint64)
    return (mix64(mix64(left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + right) & HASH).view(np.int64)


def pack_chunk(texts: list[bytes], training: np.ndarray) -> bytes:
    """Distinct word keys, the word numbers of all texts end to end, their lengths, and which texts are learned from."""
    parts = [hashed(x) for x in texts]
    words, numbers = np.unique(np.concatenate(parts), return_inverse=True)
    # Rising keys as differences, whose high bytes are alike.
    keys = np.ascontiguousarray(np.diff(words, prepend=0).view(np.uint8).reshape(-1, 8).T)
    arrays = (keys, (numbers & 255).astype("u1"), (numbers >> 8).astype("<u4"), np.array([len(p) for p in parts], "<i8"), training.astype("u1"))
    head = np.array([len(words), len(numbers), len(parts)], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


class Chunk:
    """Texts of a chunk as word numbers, and its distinct pairs and triples of kept pairs."""

    def __init__(self, blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob)
        n_words, n_tokens, n_texts = np.frombuffer(data, "<i8", 3).tolist()
        at, out = 24, []
        for kind, n in (("<i8", n_words), ("u1", n_tokens), ("<u4", n_tokens), ("<i8", n_texts), ("u1", n_texts)):
            out.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        keys, low, high, self.lengths, training = out
        self.words = np.cumsum(np.ascontiguousarray(keys.view(np.uint8).reshape(8, -1).T).view("<i8").ravel())
        self.tokens = low.astype(np.int64) + (high.astype(np.int64) << 8)
        self.owner = np.repeat(np.arange(n_texts), self.lengths)
        self.learned = training.astype(bool)[self.owner]
        # Positions of pairs: both words in one text.
        self.at = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        keys = gram_keys(self.words[self.tokens[self.at]], self.words[self.tokens[self.at + 1]])
        self.pairs, first, self.pair = np.unique(keys, return_index=True, return_inverse=True)
        # First and last word of each distinct pair.
        self.head, self.tail = self.tokens[self.at[first]], self.tokens[self.at[first] + 1]

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training occurrences of the distinct words and pairs."""
        return (np.bincount(self.tokens, self.learned, len(self.words)), np.bincount(self.pair, self.learned[self.at], len(self.pairs)))

    def find_triples(self, kept: np.ndarray) -> np.ndarray:
        """Distinct triples whose pairs are both kept; returns their training occurrences."""
        follows = (self.at[1:] == self.at[:-1] + 1) & kept[self.pair[:-1]] & kept[self.pair[1:]]
        place = np.flatnonzero(follows)
        keys = gram_keys(self.pairs[self.pair[place]], self.pairs[self.pair[place + 1]])
        self.triples, first, triple = np.unique(keys, return_index=True, return_inverse=True)
        # First and last pair of each distinct triple.
        self.front, self.back = self.pair[place[first]], self.pair[place[first] + 1]
        # Where they end, among all tokens.
        self.triple, self.triple_end = triple, self.at[place] + 2
        return np.bincount(triple, self.learned[self.at[place]], len(self.triples))


class Automaton:
    """The part of the automaton that a chunk's texts can touch: states are the empty history, the chunk's words, and its kept pairs."""

    def __init__(self, chunk: Chunk, least: float, answers: list[dict[int, np.ndarray]]):
        counts, triples = answers[0], answers[1]
        self.total, self.distinct = int(counts[WHOLE][0, 0]), int(triples[WHOLE][0, 0])
        self.chunk, self.words = chunk, counts[WORDS][:, 0]
        self.pairs, own_pairs = _columns(counts.get(PAIRS))
        self.kept = self.pairs >= least
        chunk.find_triples(self.kept)
        self.triples, own_triples = _columns(triples.get(TRIPLES))
        self.strong = self.triples >= least
        self.single = (self.words + 1.0) / (self.total + self.distinct + 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            # Kept n-grams have kept histories; the others are never read.
            self.pair_share = (self.pairs - DISCOUNT) / self.words[chunk.head]
            self.triple_share = (self.triples - DISCOUNT) / self.pairs[chunk.front]
        self.owned = (own_pairs > 0) & self.kept, (own_triples > 0) & self.strong

        # Histories that have arcs which this chunk may not hold: as often as an arc outside of it.
        words, pairs = chunk.own_counts()
        self.asked = {WORDS: self.words - words >= least, PAIRS: self.kept & (self.pairs - pairs >= least)}

    def arcs_of(self, pairs: np.ndarray, triples: np.ndarray) -> dict[int, np.ndarray]:
        """What some pairs and triples give to their histories, as whole numbers (n, 3): sum of their counts, their
        number, and the sum of the counts they have by the shorter history (of words, plus one each)."""
        chunk = self.chunk
        words = (self.pairs[pairs], np.ones(len(pairs)), self.words[chunk.tail[pairs]] + 1)
        states = (self.triples[triples], np.ones(len(triples)), self.pairs[chunk.back[triples]])
        return {
            WORDS: np.stack([np.bincount(chunk.head[pairs], x, len(chunk.words)) for x in words], 1),
            PAIRS: np.stack([np.bincount(chunk.front[triples], x, len(chunk.pairs)) for x in states], 1),
        }

    def given_out(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(key space, keys, numbers): what the n-grams owned here give, and the histories asked about."""
        own = self.arcs_of(*map(np.flatnonzero, self.owned))
        sent = {space: self.asked[space] | (own[space][:, 1] > 0) for space in own}
        keys = {WORDS: self.chunk.words, PAIRS: self.chunk.pairs}
        return [(space, keys[space][sent[space]], own[space][sent[space]]) for space in own]

    def failures(self, answers: dict[int, np.ndarray]) -> list[np.ndarray]:
        """log10 weights of the failure arcs of all words and pairs of the chunk; zero for a state without arcs."""
        chunk = self.chunk
        here, own = self.arcs_of(np.flatnonzero(self.kept), np.flatnonzero(self.strong)), self.arcs_of(*map(np.flatnonzero, self.owned))
        out = []
        for space, size in ((WORDS, self.words), (PAIRS, self.pairs)):
            sums = here[space]
            sent = self.asked[space] | (own[space][:, 1] > 0)
            # The answer counts all arcs, wherever they are held; without one all are held here.
            if space in answers:
                sums[sent] = answers[space][:, :3]
            given, number, below = sums.T
            if space == WORDS:
                below = below / (self.total + self.distinct + 1.0)
            else:
                below = (below - DISCOUNT * number) / np.maximum(self.words[chunk.tail], 1)
            given = (given - DISCOUNT * number) / np.maximum(size, 1)
            out.append(np.where(number > 0, np.log10(np.maximum(1 - given, LEAST) / np.maximum(1 - below, LEAST)), 0.0))
        return out

    def compile(self, fails: dict[int, np.ndarray]) -> None:
        """Resolve the arcs at every token: the weights of those that read it from a pair, a word and the empty state
        (``NO_ARC`` where there is none), and what the failure arcs of the states that end in it cost."""
        chunk, n = self.chunk, len(self.chunk.tokens)
        words, pairs = self.failures(fails)
        self.from_pair, self.from_word, self.pair_fails = np.full(n, NO_ARC), np.full(n, NO_ARC), np.zeros(n)
        end, kept = chunk.at + 1, self.kept[chunk.pair]
        self.from_word[end[kept]] = np.log10(self.pair_share)[chunk.pair[kept]]
        self.pair_fails[end[kept]] = pairs[chunk.pair[kept]]
        strong = self.strong[chunk.triple]
        self.from_pair[chunk.triple_end[strong]] = np.log10(self.triple_share)[chunk.triple[strong]]
        self.from_empty, self.word_fails = np.log10(self.single)[chunk.tokens], words[chunk.tokens]

    def weight(self, start: int, end: int) -> float:
        """Weight of the path that reads the tokens of a text from left to right, beginning in the empty state."""
        state, total = EMPTY, 0.0
        pair_cost = word_cost = 0.0  # of the failure arcs of the state in hand and of its suffix
        for by_pair, by_word, by_none, pair_fail, word_fail in zip(
            *[x[start:end].tolist() for x in (self.from_pair, self.from_word, self.from_empty, self.pair_fails, self.word_fails)], strict=True
        ):
            if state == PAIR:
                if by_pair != NO_ARC:
                    total += by_pair
                    pair_cost, word_cost = pair_fail, word_fail
                    continue
                total += pair_cost
                state = WORD
            if state == WORD:
                if by_word != NO_ARC:
                    total += by_word
                    state, pair_cost, word_cost = PAIR, pair_fail, word_fail
                    continue
                total += word_cost
            total += by_none
            state, word_cost = WORD, word_fail
        return total


def _columns(answers: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, owned here) of an exchange with one number a key."""
    return (answers[:, 0], answers[:, 1]) if answers is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def store_chunks(docs: DataFrame, name: str, chunk_bytes: int) -> DataFrame:
    """Chunks (``node``, ``ids``, ``held_out``, ``blob``) as a table in buckets by node."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        node = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, data = batch.column(0), byte_column(batch, "text")
            training, held_out = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), bool) for c in ("training", "held_out"))
            start = 0
            while start < len(data):
                end, size = start, 0
                while end < len(data) and end - start < CHUNK_ROWS and (end == start or size + len(data[end]) <= chunk_bytes):
                    size += len(data[end])
                    end += 1
                n = pa.array([0, end - start], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([node], pa.int64()), pa.ListArray.from_arrays(n, ids.slice(start, end - start)),
                    pa.ListArray.from_arrays(n, pa.array(held_out[start:end])), pa.array([pack_chunk(data[start:end], training[start:end])], pa.binary()),
                ], names=["node", "ids", "held_out", "blob"])
                start, node = end, node + 1

    spark, bit = docs.sparkSession, bucket_bit(modulus=7)
    texts = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.coalesce(bit != 2, F.lit(False)).alias("training"), F.coalesce(bit == 2, F.lit(False)).alias("held_out")
    )
    chunks = texts.mapInArrow(work, f"node long, ids array<{kind}>, held_out array<boolean>, blob binary")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks.write.bucketBy(buckets, "node").option("path", scratch_path(spark, "lm-chunks")).saveAsTable(name)
    return spark.table(name)


def score_texts(docs: DataFrame, least: int = 2, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN, step: int = STEP) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark, name = docs.sparkSession, f"lm_chunks_{uuid.uuid4().hex}"
    try:
        chunks = store_chunks(docs, name, chunk_bytes)
        return _scored(chunks, docs.schema["doc_id"].dataType.simpleString(), least, fan_in, step)
    finally:
        # The files stay in the scratch folder; only the name goes.
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scored(chunks: DataFrame, kind: str, least: int, fan_in: int, step: int) -> DataFrame:
    n_chunks = chunks.count()

    def sums(space, values):
        return values

    def one(number) -> np.ndarray:
        return np.array([[int(number)]])

    whole = np.zeros(1, np.int64)

    def ask_words_and_pairs(batches):
        def rows():
            for batch in batches:
                for node, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    chunk = Chunk(blob)
                    words, pairs = chunk.own_counts()
                    yield from run_rows(node, WHOLE, whole, one(words.sum()))
                    yield from run_rows(node, WORDS, chunk.words, words[:, None])
                    yield from run_rows(node, PAIRS, chunk.pairs, pairs[:, None])

        yield from batches_of(rows())

    counts = exchange(chunks.select("node", "blob").mapInArrow(ask_words_and_pairs, RUN), n_chunks, sums, "lm-counts", fan_in, step)

    def ask_triples(batches):
        def rows():
            for batch in batches:
                for node, blob, got in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    chunk, answers = Chunk(blob), answer_arrays(got)
                    words, owned = _columns(answers[WORDS])
                    # Distinct words of the training texts, each told by its owner.
                    yield from run_rows(node, WHOLE, whole, one(((words > 0) & (owned > 0)).sum()))
                    pairs, _ = _columns(answers.get(PAIRS))
                    triples = chunk.find_triples(pairs >= least)
                    yield from run_rows(node, TRIPLES, chunk.triples, triples[:, None])

        yield from batches_of(rows())

    with_counts = chunks.select("node", "blob").join(by_chunk(counts, "counts"), "node").select("node", "blob", "counts")
    triples = exchange(with_counts.mapInArrow(ask_triples, RUN), n_chunks, sums, "lm-triples", fan_in, step)

    def ask_failures(batches):
        def rows():
            for batch in batches:
                for node, blob, *got in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                    automaton = Automaton(Chunk(blob), least, [answer_arrays(x) for x in got])
                    for space, keys, values in automaton.given_out():
                        yield from run_rows(node, space, keys, values)

        yield from batches_of(rows())

    with_triples = with_counts.join(by_chunk(triples, "triples"), "node").select("node", "blob", "counts", "triples")
    fails = exchange(with_triples.mapInArrow(ask_failures, RUN), n_chunks, sums, "lm-failures", fan_in, step)

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                blob, counts, triples, fails = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("blob", "counts", "triples", "fails"))
                chunk = Chunk(blob)
                automaton = Automaton(chunk, least, [answer_arrays(counts), answer_arrays(triples)])
                automaton.compile(answer_arrays(fails))
                n, ends = len(chunk.lengths), np.cumsum(chunk.lengths).tolist()
                weights = [automaton.weight(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                known = np.bincount(chunk.owner, automaton.words[chunk.tokens] > 0, n).astype(np.int64)
                base = np.bincount(chunk.owner, np.log10(automaton.single)[chunk.tokens], n)
                ids, held_out = (batch.column(batch.schema.get_field_index(c)).slice(i, 1).flatten() for c in ("ids", "held_out"))
                total = np.full(n, int(automaton.total), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, held_out, *[pa.array(x) for x in (chunk.lengths.astype(np.int64), known, total, base)], pa.array(weights, pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = chunks.join(by_chunk(counts, "counts"), "node").join(by_chunk(triples, "triples"), "node").join(by_chunk(fails, "fails"), "node", "left")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return materialise(rows.select("ids", "held_out", "blob", "counts", "triples", "fails").mapInArrow(score, schema), "lm-scores")
