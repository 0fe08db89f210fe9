"""Language of a text by a bidirectional gated recurrent network over its UTF-8 bytes.

Two gated recurrent layers read a window of bytes from either end; at every byte
their states give a probability for each language, and a document's probabilities are
the mean over all its bytes. The network is trained in numpy by backpropagation through
time on windows of a bounded sample: about ``per_language`` documents of each language,
chosen by a hash of id and text, a few windows of each. Inference reads whole texts as
windows side by side, the longest first, so that a document may have any length.

Rows: a text that is null or has no letter is ``und`` with score 0; so is every
text if there is nothing to learn from; rows with a null lang are only predicted; repeated
rows are one example; a null id is never an example. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import bucket_bit

WINDOW, HIDDEN, BLOCK = 64, 8, 2048


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter of any script (digits in other forms, such as fractions and numerals, are none)."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Network:
    """Weights of both directions: ``table`` [2, 256, 3h], ``inner`` [2, h, 3h], and the output layer.

    The thirds of 3h are the update gate, the reset gate and the candidate.
    """

    languages: list[str]
    table: np.ndarray
    inner: np.ndarray
    out: np.ndarray  # [2h, languages]
    bias: np.ndarray

    def window_sums(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the probabilities at all bytes of each window; ``codes`` [time, windows], longest window first."""
        steps, n = codes.shape
        h = self.inner.shape[1]
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), h)[:, None]  # sigmoid by tanh of the half
        table = [np.ascontiguousarray(t.T * half) for t in self.table]
        inner = [np.ascontiguousarray(u.T * half) for u in self.inner]
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]
        kept = np.zeros((steps, h, n), np.float32)
        sums = np.zeros((len(self.languages), n), np.float32)
        for side, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            state = np.zeros((h, n), np.float32)
            for t in order:
                k = active[t]
                if not k:
                    continue
                own = state[:, :k]
                x = np.take(table[side], codes[t, :k], axis=1)
                a = inner[side] @ own
                gates = x[: 2 * h]
                gates += a[: 2 * h]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new = gates[h:]
                new *= a[2 * h :]
                new += x[2 * h :]
                np.tanh(new, out=new)
                own -= new
                own *= gates[:h]
                own += new
                if side == 0:
                    kept[t, :, :k] = own
                else:
                    logit = self.out[:h].T @ kept[t, :, :k]
                    logit += self.out[h:].T @ own
                    logit += self.bias[:, None]
                    logit -= logit.max(axis=0)
                    np.exp(logit, out=logit)
                    logit /= logit.sum(axis=0)
                    sums[:, :k] += logit
        return sums

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each language over the bytes of each text (zero for an empty one)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        count = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * WINDOW
        length = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
        order = np.argsort(-length, kind="stable")
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(order), BLOCK):
            part = order[a : a + BLOCK]
            codes = np.ascontiguousarray(data[begin[part][:, None] + np.arange(WINDOW)].T)
            sums = self.window_sums(codes, length[part])
            for i, row in enumerate(sums):
                total[:, i] += np.bincount(owner[part], row, len(texts))
        return total / np.maximum(sizes, 1)[:, None]


def forward(x: np.ndarray, inner: np.ndarray):
    """States [time + 1, batch, h] of one direction and what the backward pass needs."""
    steps, n, h = x.shape[0], x.shape[1], inner.shape[0]
    state = np.zeros((steps + 1, n, h), np.float32)
    saved = []
    for t in range(steps):
        a = state[t] @ inner
        gates = 1 / (1 + np.exp(-(x[t, :, : 2 * h] + a[:, : 2 * h])))
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * a[:, 2 * h :])
        state[t + 1] = new + z * (state[t] - new)
        saved.append((z, r, new, a[:, 2 * h :]))
    return state, saved


def backward(given: np.ndarray, state: np.ndarray, saved, inner: np.ndarray):
    """Gradients of the inputs [time, batch, 3h] and of the inner weights through all steps."""
    steps, n, h = given.shape
    dx, dinner = np.zeros((steps, n, 3 * h), np.float32), np.zeros_like(inner)
    carry = np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, new, a = saved[t]
        d = given[t] + carry
        dnew = d * (1 - z) * (1 - new * new)
        dx[t, :, :h] = d * (state[t] - new) * z * (1 - z)
        dx[t, :, h : 2 * h] = dnew * a * r * (1 - r)
        dx[t, :, 2 * h :] = dnew
        da = np.concatenate([dx[t, :, : 2 * h], dnew * r], axis=1)
        dinner += state[t].T @ da
        carry = d * z + da @ inner.T
    return dx, dinner


def loss_and_gradients(weights: dict, codes: np.ndarray, target: np.ndarray):
    """Mean cross entropy over all positions of windows [time, batch], and its gradients."""
    steps, n = codes.shape
    h = weights["inner"].shape[1]
    sides = []
    for side in (0, 1):
        own = codes if side == 0 else codes[::-1]
        sides.append(forward(weights["table"][side][own], weights["inner"][side]))
    both = np.concatenate([sides[0][0][1:], sides[1][0][1:][::-1]], axis=2)
    logit = both @ weights["out"] + weights["bias"]
    logit -= logit.max(axis=2, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=2, keepdims=True)
    at = (slice(None), np.arange(n), target)
    loss = float(-np.log(p[at] + 1e-9).mean())
    p[at] -= 1
    p /= steps * n
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    grads["out"] = np.einsum("tnh,tnl->hl", both, p)
    grads["bias"] = p.sum(axis=(0, 1))
    dboth = p @ weights["out"].T
    for side in (0, 1):
        given = dboth[:, :, :h] if side == 0 else dboth[::-1, :, h:]
        dx, grads["inner"][side] = backward(given, *sides[side], weights["inner"][side])
        own = codes if side == 0 else codes[::-1]
        np.add.at(grads["table"][side], own.ravel(), dx.reshape(-1, dx.shape[2]))
    return loss, grads


def fit_network(windows: list[bytes], labels: list[str], steps: int = 300, batch: int = 128, rate: float = 0.02, hidden: int = HIDDEN) -> Network:
    """Adam on windows of exactly ``WINDOW`` bytes."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(0)
    k = len(languages)
    weights = {
        "table": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
        "inner": rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(np.float32),
        "out": rng.normal(0, 0.3, (2 * hidden, k)).astype(np.float32),
        "bias": np.zeros(k, np.float32),
    }
    if k > 1:
        data = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
        target = np.searchsorted(languages, labels)
        members = [np.flatnonzero(target == i) for i in range(k)]
        mean, square = ({n: np.zeros_like(w) for n, w in weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            language = rng.integers(0, k, batch)  # every language equally often
            chosen = np.array([members[i][rng.integers(0, len(members[i]))] for i in language])
            _, grads = loss_and_gradients(weights, data[chosen].T, target[chosen])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, g in grads.items():
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.01 * (g * g - square[n])
                weights[n] -= now * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-7)
    return Network(languages, weights["table"], weights["inner"], weights["out"], weights["bias"])


def fit_language_id(docs: DataFrame, per_language: int = 250, windows: int = 6) -> Network:
    """Train on documents with a language outside the held-out quarter."""
    own = docs.where("lang is not null and doc_id is not null").where(bucket_bit(modulus=4) != 2)
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return fit_network([], [])
    share = [x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(int(1_000_000 * min(1.0, per_language / n))))]
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1_000_000))
    # Rows that repeat an id and its text are one example.
    chosen = own.where(part < F.element_at(F.create_map(*share), F.col("lang"))).select("doc_id", "lang", "text").distinct()

    def cut(batches):
        for batch in batches:
            pieces, langs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if not has_letter(text):
                    continue
                span = max(0, len(data) - WINDOW)
                for i in range(min(windows, 1 + span // WINDOW)):  # spread over the whole text
                    at = span * i // max(1, windows - 1)
                    piece = data[at : at + WINDOW]
                    pieces.append((piece * (WINDOW // len(piece) + 1))[:WINDOW]), langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(langs, pa.string())], names=["piece", "lang"])

    rows = chosen.select("lang", "text").mapInArrow(cut, "piece binary, lang string").toPandas()
    rows = sorted((bytes(p), lang) for p, lang in zip(rows["piece"], rows["lang"], strict=True))
    return fit_network([p for p, _ in rows], [lang for _, lang in rows])


def predict_language(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row."""

    def work(batches):
        for batch in batches:
            texts = [t if has_letter(t) else "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            if network.languages:
                p = network.probabilities([t.encode() for t in texts])
                best, score = p.argmax(axis=1), np.minimum(p.max(axis=1), 1.0)
                names = [network.languages[i] if t else "und" for i, t in zip(best.tolist(), texts, strict=True)]
            else:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score.astype(float))], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(bucket_bit(modulus=4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
