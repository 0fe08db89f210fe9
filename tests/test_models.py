"""Features against a plain computation; fits against Newton solutions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import features as ft
from reviewloom.operators import training as tr
from reviewloom.operators.linear import term_scores
from reviewloom.plans.splits import build_corpus_splits, build_second_corpus_splits
from reviewloom.plans.training import (
    KINDS, build_features, evaluate_models, evaluate_on_second_corpus, store_models, tune_models,
)
from reviewloom.sinks.tables import load_models
from reviewloom.sources.corpus import scan_processed

TEXTS = [
    "The film was good, the cast was good", "a bad bad film", "good good good", "wouldn't watch a film", "",
    None, "été film 中文 x", "the cast", "one_two the film", "the THE the",
]


def python_tfidf(train, texts, k):
    def terms(t):
        tok = re.findall(r"\b\w\w+\b", (t or "").lower())
        return Counter(tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])])

    docs = [terms(t) for t in train]
    df, cf = Counter(t for d in docs for t in d), sum(docs, Counter())
    kept = sorted((t for t in df if df[t] >= 2 and df[t] <= 0.9 * len(train)), key=lambda t: (-cf[t], t))[:k]
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in sorted(kept)}
    rows = []
    for d in map(terms, texts):
        w = {t: (1 + math.log(d[t])) * idf[t] for t in idf if t in d}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows.append({t: x / norm for t, x in w.items()})
    return list(idf), rows


@pytest.mark.parametrize("k,most", [(50_000, 1_000_000), (4, 1_000_000), (50_000, 0)])  # 0: shuffled by term
def test_tfidf(spark, k, most):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    names, want = python_tfidf(TEXTS, TEXTS, k)
    vocabulary = ft.fit_vocabulary(df, "id", "t", ft.TfidfSettings(max_features=k))
    assert [r["term"] for r in vocabulary.orderBy("idx").collect()] == names
    df = df.union(df.where("id = 0"))  # a repeated id stays a row of its own
    rows = ft.tfidf_vectors(df, vocabulary, "id", "t", broadcast_terms=most).collect()
    assert len(rows) == len(TEXTS) + 1  # also documents without a known term
    for r in rows:
        got = {names[i]: v for i, v in zip(r["indices"], r["values"])}
        assert got == pytest.approx(want[r["id"]]) and list(r["indices"]) == sorted(r["indices"])
    coefs = vocabulary.select(F.lit("m").alias("model"), "term", (F.col("idx") - 1.5).alias("coef"))
    for r in term_scores(df, vocabulary, coefs, {"m": 0.25}, "id", "t", broadcast_terms=most).collect():
        dot = sum(v * (names.index(t) - 1.5) for t, v in want[r["id"]].items())
        assert r["margins"]["m"] == pytest.approx(dot + 0.25)


def dense(seed=0, n=300, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ np.array([1.5, 1.0, -0.5]) - 0.4 + rng.logistic(size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, int(b), list(range(x.shape[1])), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, label int, indices array<int>, values array<double>").repartition(parts)


def newton(x, y, c, kind):
    a = np.hstack([x, np.ones((len(x), 1))])
    s, w = np.where(y == 1, 1.0, -1.0), np.zeros(x.shape[1] + 1)
    pen = np.ones(len(w))
    pen[-1] = 0.0 if kind == "logistic" else 1.0
    for _ in range(200):
        m = s * (a @ w)
        if kind == "logistic":
            p = 1 / (1 + np.exp(m))
            g, h = -s * p, p * (1 - p)
        else:
            active = m < 1
            g, h = -2 * s * np.maximum(0, 1 - m), 2.0 * active
        w = w - np.linalg.solve(np.diag(pen) + c * (a.T * h) @ a, pen * w + c * a.T @ g)
    return w


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge"])
@pytest.mark.parametrize("parts", [3, 24])  # 24 goes through the tree
def test_fit_equals_newton(spark, kind, parts):
    x, y = dense()
    fits = tr.fit_linear(
        frame(spark, x, y, parts), [tr.Problem(str(c), c) for c in (0.01, 1.0, 100.0)], kind, 3, tolerance=1e-9
    )
    for fit in fits:
        want = newton(x, y, fit.c, kind)
        assert np.append(fit.weights, fit.intercept) == pytest.approx(want, abs=1e-5)


def test_fit_equals_spark_ml(spark, tmp_path):
    x, y = dense(1)
    rows = frame(spark, x, y)
    model = tr.fit_logistic_ml(ft.ml_vectors(rows, 3, str(tmp_path / "v")), 1.0, len(y))
    fit = tr.fit_linear(rows, [tr.Problem("c", 1.0)], "logistic", 3, tolerance=1e-9)[0]
    assert fit.weights == pytest.approx(model.coefficients.toArray(), abs=1e-4)
    hinge = tr.fit_hinge_ml(ft.ml_vectors(rows, 3, str(tmp_path / "h")), 1.0, len(y))
    assert hinge.coefficients.size == 3


def test_calibration(spark):
    x, y = dense(2)
    rows = frame(spark, x, y)
    model = tr.calibrate(rows, 1.0, 3, tolerance=1e-9)
    folds = {r["id"]: r["fold"] for r in tr.stratified_folds(rows).collect()}
    fold = np.array([folds[i] for i in range(len(y))])
    probability = np.zeros(len(y))
    for k, fit in enumerate(model.fits, start=1):
        w = newton(x[fold != k], y[fold != k], 1.0, "squared_hinge")
        assert np.append(fit.weights, fit.intercept) == pytest.approx(w, abs=1e-5)
        f, t = (x @ w[:3] + w[3])[fold == k], y[fold == k]
        hi, lo = (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2)
        target = np.where(t == 1, hi, lo)
        ab = np.zeros(2)
        design = np.stack([f, np.ones_like(f)], axis=1)
        for _ in range(100):
            p = 1 / (1 + np.exp(design @ ab))
            ab -= np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-12 * np.eye(2), design.T @ (target - p))
        assert model.sigmoids[k] == pytest.approx(tuple(ab), abs=1e-5)
        probability += 1 / (1 + np.exp(ab[0] * (x @ w[:3] + w[3]) + ab[1])) / 5
    got = tr.calibrated_probabilities(rows, model, keep=["label"]).orderBy("id").collect()
    assert [r["probability"] for r in got] == pytest.approx(probability, abs=1e-5)
    assert [r["pred"] for r in got] == [int(p > 0.5) for p in probability]


def test_whole_flow(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = {1: ["great", "fine", "loved"], 0: ["awful", "dull", "hated"]}
    rows = []
    for i in range(400):
        label, split = int(i % 2), "train" if i < 300 else "test"
        body = " ".join(rng.choice([*words[label], "film", "plot", "cast", "very"], 12))
        rows.append((f"r{i}", f"<p>{body}</p> {i}", label, split))
    rows.append(("leak", rows[350][1], rows[350][2], "train"))
    corpus = spark.createDataFrame(rows, "id string, text_raw string, label int, split string")
    path = str(tmp_path / "splits")
    assert build_corpus_splits(corpus, "first", path) == {"rows_before": 301, "rows_after": 300, "rows_removed": 1}
    second = corpus.where("split = 'test'").limit(40).select("text_raw", "label", F.lit("validation").alias("split"), "id")
    build_second_corpus_splits(second, "second", path)
    parts = {s: scan_processed(spark, path, "first", s) for s in ("train", "validation", "test")}
    assert {s: f.count() for s, f in parts.items()} == {"train": 270, "validation": 30, "test": 100}
    assert parts["train"].join(parts["validation"], "id").count() == 0
    features = build_features(parts, vocabulary_path=str(tmp_path / "vocabulary"))
    tuned = tune_models(features, grid=[0.1, 1.0])
    assert [r["grid_pos"] for r in tuned["svm"].grid.orderBy("grid_pos").collect()] == [0, 1]
    scores = {r["model"]: r["f1"] for r in evaluate_models(tuned, features.rows["test"]).collect()}
    assert set(scores) == set(KINDS) and min(scores.values()) > 0.95
    other = evaluate_on_second_corpus(tuned, features, scan_processed(spark, path, "second", "validation"))
    assert min(r["f1"] for r in other.collect()) > 0.9
    store_models(spark, tuned, features.vocabulary, str(tmp_path / "models"))
    coefs, intercepts = load_models(spark, str(tmp_path / "models"))
    again = term_scores(parts["test"], features.vocabulary, coefs, intercepts, "id", "text_clean_classical")
    direct = {r["id"]: r["margins"] for r in again.collect()}
    fit = tuned["svm"].best
    for r in features.rows["test"].collect():
        z = sum(fit.weights[i] * v for i, v in zip(r["indices"], r["values"])) + fit.intercept
        assert direct[r["id"]]["svm"] == pytest.approx(z)


@pytest.mark.parametrize("label", [-1, 2, None])
def test_labels_outside_the_contract_are_an_error(spark, label):
    x, y = dense(2, 20)
    rows = frame(spark, x, y).union(spark.createDataFrame([(99, label, [0], [1.0])], "id int, label int, indices array<int>, values array<double>"))
    with pytest.raises(Exception, match="labels of a fit must be 0 or 1"):
        tr.fit_linear(rows, [tr.Problem("c", 1.0)], "logistic", 3)


def test_passes_use_few_tasks_for_few_rows(spark):
    x, y = dense(4)
    assert tr._tasks_for(frame(spark, x, y, 24)) == 1
    fit = tr.fit_linear(frame(spark, x, y, 24), [tr.Problem("c", 300.0)], "squared_hinge", 3)[0]
    assert fit.converged and fit.seconds > 0 and fit.passes < 60


def test_grid_keeps_the_seconds_of_every_candidate(spark):
    x, y = dense(3)
    rows = frame(spark, x, y)
    for kind in ("logistic", "squared_hinge"):
        grid = tr.tune(rows, rows, kind, 3, grid=[0.1, 1.0, 10.0]).grid.orderBy("grid_pos").collect()
        assert [r["C"] for r in grid] == [0.1, 1.0, 10.0] and all(r["fit_s"] > 0 for r in grid)


def test_fits_run_side_by_side(spark):
    import threading

    both = threading.Barrier(2, timeout=60)
    seen = tr.side_by_side(spark, lambda i: (both.wait(), spark.sparkContext.getLocalProperty("spark.scheduler.pool"))[1], [0, 1])
    assert seen == ["fit-0", "fit-1"] and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_sigmoids_of_separated_margins(spark):
    """Margins far apart and a fold with one class: the ladder finds steps that help."""
    rows = [(1, i % 2, 40.0 if i % 2 else -40.0) for i in range(60)] + [(2, 1, float(i)) for i in range(20)] + [(3, i % 2, 0.01 * i) for i in range(30)]
    scored = spark.createDataFrame(rows, "fold int, label int, margin double").repartition(3)
    found = tr._platt(scored)
    for k, (a, b) in found.items():
        own = [(label, m) for fold, label, m in rows if fold == k]
        pos = sum(label for label, _ in own)
        hi, lo = (pos + 1) / (pos + 2), 1 / (len(own) - pos + 2)
        t, m = np.array([hi if label else lo for label, _ in own]), np.array([v for _, v in own])
        p = 1 / (1 + np.exp(a * m + b))
        assert abs((t - p).sum()) < 1e-6 and abs(((t - p) * m).sum()) < 1e-4


def test_a_pass_sends_one_sum_to_the_driver(spark, monkeypatch):
    import pickle

    from pyspark import RDD

    sent, collect = [], RDD.collect

    def recorded(self):
        found = collect(self)
        sent.append(len(pickle.dumps(found)))
        return found

    rng, width, problems = np.random.default_rng(5), 20_000, [tr.Problem(f"C={c:g}", c) for c in (1.0, 10.0)]
    # One row without any feature; indices up to the last one.
    lists = [[], *(sorted(rng.choice(width, 30, replace=False).tolist()) for _ in range(199)), [width - 1]]
    rows = [(i, i % 2, x, [1.0 / (1 + j) for j in range(len(x))]) for i, x in enumerate(lists)]
    rows = spark.createDataFrame(rows, "id int, label int, indices array<int>, values array<double>").repartition(6)
    few = tr.fit_linear(rows, problems, "squared_hinge", width)
    monkeypatch.setattr(tr, "NONZEROS_PER_TASK", 100)
    monkeypatch.setattr(RDD, "collect", recorded)
    many = tr.fit_linear(rows, problems, "squared_hinge", width)
    assert len(sent) > 3 and max(sent) < 1.2 * len(problems) * 8 * (width + 2)
    for a, b in zip(few, many, strict=True):
        assert b.loss == pytest.approx(a.loss, rel=1e-6) and b.weights == pytest.approx(a.weights, abs=1e-3)


def test_long_batches_are_worked_on_in_slices():
    import pyarrow as pa

    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"] * 2, ["d"] * 2, []], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), lists], names=["id", "t"])
    parts = list(ft.bounded_slices(batch.slice(0), 1, 4))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [p.column("id").to_pylist() for p in ft.bounded_slices(batch.slice(3), 1, 100)] == [[3, 4, 5, 6]]
    assert list(ft.bounded_slices(batch.slice(0, 0), 1, 4)) == []


def test_a_slice_for_each_few_tokens_gives_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "id int, t string").coalesce(1)
    vocabulary = ft.fit_vocabulary(df, "id", "t")
    whole = ft.tfidf_vectors(df, vocabulary, "id", "t").collect()
    monkeypatch.setattr(ft, "TOKENS_AT_ONCE", 2)
    assert ft.tfidf_vectors(df, vocabulary, "id", "t").collect() == whole


def test_logistic_fits_that_run_together_share_the_cores(spark, monkeypatch):
    tasks, plain = [], tr.fit_logistic_ml

    def seen(train, *args):
        tasks.append(train.rdd.getNumPartitions())
        return plain(train, *args)

    x, y = dense(6)
    rows, problems = frame(spark, x, y, 24), [tr.Problem(f"C={c:g}", c) for c in (0.1, 1.0, 10.0, 100.0)]
    alone = [tr.fit_linear(rows, [p], "logistic", 3, tolerance=1e-9)[0] for p in problems]
    monkeypatch.setattr(tr, "NONZEROS_PER_TASK", 1)  # rows worth a task on every core
    monkeypatch.setattr(tr, "fit_logistic_ml", seen)
    together = tr.fit_linear(rows, problems, "logistic", 3, tolerance=1e-9)
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and len(tasks) == 4 and max(tasks) <= -(-cores // 4)
    for a, b in zip(alone, together, strict=True):
        assert b.weights == pytest.approx(a.weights, abs=1e-5) and b.intercept == pytest.approx(a.intercept, abs=1e-5)


def test_sums_of_blocks_with_rows_without_features():
    """Empty rows at the start, between and at the end, a block of nothing else, and a fold that is left out."""
    rng, d = np.random.default_rng(1), 4

    class Weights:
        value = rng.normal(size=(2, d + 1))

    blocks, expected = [], np.zeros((2, d + 2))
    for lists in ([[], [0, 3], [], [1], []], [[], []], [[2, 3]]):
        y, fold, n = rng.choice([-1.0, 1.0], len(lists)), rng.integers(0, 2, len(lists)).astype(np.int32), np.array([len(x) for x in lists], np.int32)
        idx = np.array([i for x in lists for i in x], np.int32)
        val = rng.random(len(idx))
        blocks.append((y, fold, n, idx, val))
        x = np.zeros((len(lists), d))
        x[np.repeat(np.arange(len(lists)), n), idx] = val
        for p, out in enumerate((None, 1)):
            w, kept = Weights.value[p], np.ones(len(y)) if out is None else fold != out
            gap = np.maximum(0.0, 1 - y * (x @ w[:d] + w[d])) * kept
            expected[p] += [gap @ gap, *(-2 * (gap * y) @ x), -2 * gap @ y]
    assert next(tr._partial_sums([None, 1], Weights)(blocks)) == pytest.approx(expected, abs=1e-12)


def test_steps_of_the_search_start_no_threads_of_blas(monkeypatch):
    """Those threads spin on the cores of the tasks: no product of long vectors goes through BLAS."""

    class Watched(np.ndarray):
        def __matmul__(self, other):
            raise AssertionError("product by BLAS")

        dot = __rmatmul__ = __matmul__

    rng, d = np.random.default_rng(2), 50
    search = tr._Lbfgs(tr.Problem("c", 1.0), np.ones(d).view(Watched), 1e-9, 100)
    search.point = search.trial = search.point.view(Watched)
    target = rng.normal(size=d)
    while not search.done and search.passes < 200:
        gap = np.asarray(search.trial) - target
        search.feed(np.concatenate([[gap @ gap], 2 * gap]).view(Watched))
    assert search.converged and np.asarray(search.point) == pytest.approx(target * 2 / 3, abs=1e-6)


def test_passes_map_the_rows_from_files(spark, monkeypatch):
    """No pass carries the rows from the JVM to Python; both ways give the same bits, and no file is left."""
    from pathlib import Path

    from pyspark import RDD

    from reviewloom.storage import shared_root

    rng, width, problems = np.random.default_rng(7), 500, [tr.Problem(f"C={c:g}", c) for c in (0.1, 10.0)]
    lists = [[], None, *(sorted(rng.choice(width, 20, replace=False).tolist()) for _ in range(300)), [width - 1]]
    rows = [(i, i % 2, x, None if x is None else [1.0 / (1 + j) for j in range(len(x))]) for i, x in enumerate(lists)]
    rows = spark.createDataFrame(rows, "id int, label int, indices array<int>, values array<double>").repartition(5)
    kept, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *args: (kept.append(self), persist(self, *args))[1])
    monkeypatch.setattr(tr, "NONZEROS_PER_TASK", 1000)
    mapped = tr.fit_linear(rows, problems, "squared_hinge", width)
    assert not kept and not list(Path(shared_root(spark)).glob("blocks-*"))
    monkeypatch.setattr(tr, "local_folder", lambda *_: None)
    carried = tr.fit_linear(rows, problems, "squared_hinge", width)
    assert kept
    for a, b in zip(mapped, carried, strict=True):
        assert a.converged and a.iterations == b.iterations and a.weights.tolist() == b.weights.tolist()


def test_folders_of_other_stores_are_not_mapped(spark, tmp_path):
    from reviewloom.storage import local_folder

    assert local_folder(spark, str(tmp_path)) == local_folder(spark, f"file://{tmp_path}") == str(tmp_path)
    spark.conf.set("spark.hadoop.fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    assert local_folder(spark, "viewfs://store/in/x") is None


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_term_sums_of_slices(monkeypatch, most):
    """Frequencies of slices add up to those of the rows: empty, null and repeated ones, pairs inside a row only."""
    import pyarrow as pa

    lists = [["b", "a", "b", "a"], [], None, ["a"], ["a", "b"], ["b", "a", "b", "a"], ["é", "中"]]
    df, cf = Counter(), Counter()
    for tokens in lists:
        terms = Counter((tokens or []) + [f"{a} {b}" for a, b in zip(tokens or [], (tokens or [])[1:])])
        cf.update(terms)
        df.update(terms.keys())
    monkeypatch.setattr(ft, "TOKENS_AT_ONCE", most)
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["tokens"])
    got_df, got_cf = Counter(), Counter()
    for part in ft._term_sums([batch, batch.slice(0, 0)]):
        for r in part.to_pylist():
            got_df[r["term"]] += r["df"]
            got_cf[r["term"]] += r["cf"]
    assert (got_df, got_cf) == (df, cf)
