"""Gradients against differences, batched inference against the plain network, held-out accuracy."""

import numpy as np

from reviewloom.llm.common import table
from reviewloom.llm.language_id import WINDOW, fit_language_id, fit_network, forward, loss_and_gradients, predict_language

SF = "/root/testdata/sf0.01"


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    weights = {"table": rng.normal(size=(2, 256, 6)), "inner": rng.normal(size=(2, 2, 6)), "out": rng.normal(size=(4, 3)), "bias": rng.normal(size=3)}
    weights = {k: v.astype(np.float64) for k, v in weights.items()}
    codes, target = rng.integers(0, 4, (7, 5)), rng.integers(0, 3, 5)
    _, grads = loss_and_gradients(weights, codes, target)
    for name in weights:
        for _ in range(6):
            at = tuple(int(rng.integers(0, s if name != "table" or i != 1 else 4)) for i, s in enumerate(weights[name].shape))
            old = weights[name][at]
            weights[name][at] = old + 1e-3
            up = loss_and_gradients(weights, codes, target)[0]
            weights[name][at] = old - 1e-3
            down = loss_and_gradients(weights, codes, target)[0]
            weights[name][at] = old
            assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-4, name


def test_batched_equals_plain():
    rng = np.random.default_rng(1)
    network = fit_network([bytes(rng.integers(0, 256, WINDOW, dtype=np.uint8)) for _ in range(20)], ["a", "b"] * 10, steps=3)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, 63, 64, 65, 300, 0)]
    for text, got in zip(texts, network.probabilities(texts), strict=True):
        total = np.zeros(2)
        for a in range(0, len(text), WINDOW):
            codes = np.frombuffer(text[a : a + WINDOW], np.uint8)[:, None]
            one = forward(network.table[0][codes], network.inner[0])[0][1:, 0]
            two = forward(network.table[1][codes[::-1]], network.inner[1])[0][1:, 0][::-1]
            logit = np.concatenate([one, two], axis=1) @ network.out + network.bias
            p = np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True)
            total += p.sum(axis=0)
        assert np.allclose(got, total / max(1, len(text)), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = predict_language(docs, fit_language_id(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    own = got[got.held_out]
    assert len(own) > 100 and (own.lang_pred == own.lang).mean() >= 0.98


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "12 .. _ ½ ² Ⅷ ①", "en"), (None, "the and of it", "en"), (3, "der und das ist", "de"), (3, "der und das ist", None), (5, "the of " * 150_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as score")
    got = predict_language(docs, fit_language_id(docs)).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2)] == ["und", "und"] and len(got) == 6
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in predict_language(docs, fit_language_id(docs.limit(0))).collect()} == {"und"}
    assert predict_language(docs.limit(0), fit_language_id(docs)).count() == 0
