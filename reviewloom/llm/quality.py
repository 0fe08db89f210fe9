"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted in numpy on the statistics of a bounded sample of labelled rows
(``sample_rows`` expected rows, chosen by a hash of the id) and flattened into
arrays; executors compute the statistics of whole texts and walk all trees at once.

Rows: null and empty texts have statistics of zero and get a score like any other;
null labels and null ids are no examples; a repeated row or label counts as often as it
occurs; with one class or no example the score is the share of label 1 (0.5 for none).
Extra columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import bucket_bit, byte_column

FEATURES = (
    "bytes", "words", "lines", "word_length", "longest_word", "short_words", "long_words", "distinct_words", "distinct_lines",
    "line_length", "upper", "digits", "spaces", "high", "stops", "commas", "exclaims", "bars", "symbols", "marks", "top_word",
)


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars)).astype(float)


UPPER, DIGITS, SPACES = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b" \t\n\r\x0b\x0c")
SYMBOLS, MARKS = _class(b"#$%&*@^~+=<>{}[]\\/_"), _class(b"\"'()-:;?")


def statistics(data: bytes) -> list[float]:
    """The values named by ``FEATURES`` for one whole text."""
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    nw = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    nl = max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), np.log1p(lengths.max()),
        (lengths <= 3).mean(), (lengths >= 12).mean(), len(tally) / nw, len(set(lines)) / nl, np.log1p(n / nl),
        count @ UPPER / n, count @ DIGITS / n, count @ SPACES / n, count[128:].sum() / n, count[46] / nw, count[44] / nw,
        count[33] / nw, count[124] / nw, count @ SYMBOLS / n, count @ MARKS / n, max(tally.values(), default=0) / nw,
    ]


@dataclass
class Trees:
    """Complete binary trees as arrays: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # [trees, inner nodes]
    threshold: np.ndarray  # go right if value > threshold
    leaf: np.ndarray  # [trees, leaves]
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        for a in range(0, len(x) if self.feature.size else 0, 4096):
            part = x[a : a + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            tree, row = np.arange(len(self.feature))[None, :], np.arange(len(part))[:, None]
            while node[0, 0] < inner:
                value = part[row, self.feature[tree, node]]
                node = 2 * node + 1 + (value > self.threshold[tree, node])
            margin[a : a + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
              penalty: float = 1.0, least_weight: float = 2.0) -> Trees:
    """Boosted trees on logistic loss; splits are searched in histograms of ``bins`` quantile bins."""
    n, inner = len(y), 2**depth - 1
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width, features = bins, x.shape[1]
    flat = binned + np.arange(features) * width
    margin = np.full(n, bias)
    feature, threshold = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, inner + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (features * width) + flat).ravel()
            shape = (count, features, width)
            hist_g = np.bincount(at, np.repeat(g, features), count * features * width).reshape(shape).cumsum(axis=2)
            hist_h = np.bincount(at, np.repeat(h, features), count * features * width).reshape(shape).cumsum(axis=2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            right_g, right_h = all_g - hist_g, all_h - hist_h
            gain = hist_g**2 / (hist_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            gain = np.where((hist_h >= least_weight) & (right_h >= least_weight), gain, 0).reshape(count, -1)
            best = gain.argmax(axis=1)
            for i in range(count):
                f, b = divmod(int(best[i]), width)
                feature[t, first + i] = f
                if gain[i, best[i]] > 1e-9 and b < len(cuts[f]):
                    threshold[t, first + i] = cuts[f][b]
            own = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), own] > threshold[t, node])
        slot = node - inner
        leaf[t] = rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + penalty)
        margin += leaf[t, slot]
    return Trees(feature, threshold, leaf, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Trees:
    """Fit on labelled rows outside the held-out third; about ``sample_rows`` of them are used."""
    own = labels.where("quality is not null and doc_id is not null").where(bucket_bit(modulus=3) != 1)
    own = own.select("doc_id", F.col("quality").cast("double").alias("quality"))
    total = own.count()
    part = int(1_000_000 * min(1.0, sample_rows / max(1, total)))
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) < part)

    def work(batches):
        for batch in batches:
            rows = np.array([statistics(x) for x in byte_column(batch, "text")]).reshape(-1, len(FEATURES))
            quality = batch.column(batch.schema.get_field_index("quality"))
            yield pa.RecordBatch.from_arrays([quality, *map(pa.array, rows.T.copy())], names=["quality", *FEATURES])

    schema = ", ".join(f"{n} double" for n in ("quality", *FEATURES))
    # ``chosen`` has about sample_rows short rows, however many labels there are.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    found = joined.mapInArrow(work, schema).toPandas().to_numpy()
    order = np.lexsort(found.T)  # the same trees in whatever order tasks end
    return fit_trees(found[order, 1:], found[order, 0])


def quality_scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""

    def work(batches):
        for batch in batches:
            rows = np.array([statistics(x) for x in byte_column(batch, "text")]).reshape(-1, len(FEATURES))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(trees.scores(rows))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")
    held_out = F.coalesce(bucket_bit(modulus=3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores at least 0.5."""

    def work(batches):
        for batch in batches:
            rows = np.array([statistics(x) for x in byte_column(batch, "text")]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(trees.scores(rows) >= 0.5))

    return docs.mapInArrow(work, docs.schema)
