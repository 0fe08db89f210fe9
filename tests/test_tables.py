"""Splits, leakage, inspection and order statistics against brute force."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import inspection as ins
from reviewloom.operators import leakage as lk
from reviewloom.operators.ranking import timing_statistics
from reviewloom.operators.splitting import stratified_folds, stratified_sample, stratified_split


def ordered(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, 1 if rng.random() < 0.85 else 0) for i in range(997)]
    return rows, spark.createDataFrame(rows, "id long, label int").repartition(7).cache()


def quotas(rows, fraction):
    sizes = {k: sum(r[1] == k for r in rows) for k in (0, 1)}
    want, n = math.ceil(fraction * len(rows)), len(rows)
    k = {c: want * s // n for c, s in sizes.items()}
    for c in sorted(sizes, key=lambda c: (-(want * sizes[c] / n - k[c]), c))[: want - sum(k.values())]:
        k[c] += 1
    return k


def test_split_is_exact_and_reproducible(spark, skewed):
    rows, df = skewed
    k = quotas(rows, 0.10)
    expected = {c: set(ordered([i for i, lab in rows if lab == c])[: k[c]]) for c in (0, 1)}
    for frame in (df, df.orderBy(F.desc("id")).coalesce(1)):
        got = stratified_split(frame).collect()
        assert len(got) == len(rows) == len({r["id"] for r in got})
        for c in (0, 1):
            assert {r["id"] for r in got if r["label"] == c and r["split"] == "validation"} == expected[c]


def test_every_label_is_split_and_a_missing_one_is_an_error(spark):
    rows = [(i, [0, 1, 2, -1][i % 4]) for i in range(91)]
    df = spark.createDataFrame(rows, "id long, label int")
    for got in (stratified_split(df), stratified_sample(df, size=1000), stratified_folds(df)):
        assert sorted((r["id"], r["label"]) for r in got.collect()) == sorted(rows)
    tiny = {r["id"]: r["split"] for r in stratified_split(df.where("id < 2")).collect()}
    assert sorted(tiny.values()) == ["train", "validation"]
    assert stratified_split(df.where("id > 99")).count() == 0
    with pytest.raises(ValueError, match="2 rows have no label"):
        stratified_split(df.union(spark.createDataFrame([(200, None), (201, None)], df.schema)))


def test_summary_counts_rows_of_any_split_and_label(spark):
    rows = [("train", 0, "a b"), ("train", 2, "a b"), ("extra", 1, "c"), (None, None, " ")]
    df = spark.createDataFrame(rows, "split string, label int, text string")
    got = {r["split"]: r for r in ins.inspection_summary(df, "text", ["train", "test", "dev"], found=["test"]).collect()}
    assert {k: (r["n_rows"], r["status"]) for k, r in got.items()} == {
        "train": (2, "ok"), "test": (0, "empty"), "dev": (0, "missing"), "other": (2, "ok"), "total": (4, "ok")
    }
    assert got["total"]["class_balance"] == {"0": 1, "1": 1, "2": 1, "none": 1} and got["total"]["missing_texts"] == 1
    assert got["train"]["duplicate_texts"] == 1
    plain = ins.inspection_summary(df, "text", ["train"], label_col=None, null_as_word=True, blanks=False, median=False)
    assert "class_balance" not in plain.columns and plain.where("split = 'total'").first()["missing_texts"] == 0


def test_sample_sizes(spark, skewed):
    rows, df = skewed
    got = stratified_sample(df, size=300).collect()
    for c in (0, 1):
        ids = [i for i, lab in rows if lab == c]
        assert {r["id"] for r in got if r["label"] == c} == set(ordered(ids)[: min(150, len(ids))])
    assert stratified_sample(df, size=5000).count() == len(rows)


def test_folds_are_ntiles(spark, skewed):
    rows, df = skewed
    got = {r["id"]: r["fold"] for r in stratified_folds(df).collect()}
    for c in (0, 1):
        ids = ordered([i for i, lab in rows if lab == c])
        base, extra = divmod(len(ids), 5)
        want = [f for f in range(1, 6) for _ in range(base + (f <= extra))]
        assert [got[i] for i in ids] == want
    few = spark.createDataFrame([(i, 1) for i in range(3)], "id long, label int")
    assert sorted(r["fold"] for r in stratified_folds(few).collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(5)
    # A third of train holds one text that is also in test.
    train = ["hot"] * 300 + [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(600)] + [None, None, ""]
    test = ["hot", "hot", "aaa", "bb", "zz", None]
    rows = [(i, t, "train") for i, t in enumerate(train)] + [(10_000 + i, t, "test") for i, t in enumerate(test)]
    return rows, spark.createDataFrame(rows, "id long, text string, split string")


@pytest.mark.parametrize("limit", [lk.BROADCAST_DIGESTS, 0])
def test_leak_removal(spark, leaky, monkeypatch, limit):
    monkeypatch.setattr(lk, "BROADCAST_DIGESTS", limit)  # 0 forces the salted join
    rows, df = leaky
    test_texts = {t for _, t, s in rows if s == "test" and t is not None}
    keep = {i for i, t, s in rows if s == "train" and t not in test_texts}
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    kept = lk.remove_leaked_rows(train, test, "text")
    assert {r["id"] for r in kept.collect()} == keep and kept.columns == train.columns
    counts = lk.leak_counts(df, "text", "split").first()
    n_train = sum(s == "train" for _, _, s in rows)
    shared = {t for _, t, s in rows if s == "train"} & test_texts
    assert tuple(counts) == (n_train, len(keep), n_train - len(keep), len(shared))
    assert len(shared) != n_train - len(keep)


def test_leak_warning():
    with pytest.warns(UserWarning):
        lk.warn_if_nothing_removed(0)


def test_inspection(spark, leaky):
    rows, df = leaky
    df = df.withColumn("label", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    summary = {r["split"]: r for r in ins.inspection_summary(df, "text", ["train", "test", "val"]).collect()}
    for split in ("train", "test", "total"):
        texts = [t for _, t, s in rows if split in (s, "total")]
        words = [len(t.split()) for t in texts if t is not None]
        r = summary[split]
        assert r["n_rows"] == len(texts) and r["duplicate_texts"] == len(texts) - len(set(texts))
        assert r["missing_texts"] == sum(t is None or not t.strip() for t in texts)
        assert (r["min_words"], r["max_words"]) == (min(words), max(words))
        assert r["median_words"] == statistics.median(words)
        assert r["mean_words"] == pytest.approx(statistics.mean(words), abs=0.051)
        ids = [i for i, _, s in rows if split in (s, "total")]
        assert r["class_balance"].get("1", 0) == sum(i % 3 == 0 for i in ids)
    assert summary["val"]["status"] == "missing" and summary["val"]["n_rows"] == 0
    assert ins.duplicate_rows(df, "text").first()[0] == summary["total"]["duplicate_texts"]
    balance = ins.class_balance_map(df).where("split = 'test'").first()["class_balance"]
    assert sum(balance.values()) == 6


def test_unlabelled_and_missing(spark):
    df = spark.createDataFrame([("a", -1, None), ("a", -1, " "), ("b", -1, "x"), ("b", 1, "y")], "split string, label int, t string")
    assert {r[0]: r[1] for r in ins.unlabelled_splits(df).collect()} == {"a": True, "b": False}
    assert {r[0]: r[1] for r in ins.missing_texts(df, "t", ["split"]).collect()} == {"a": 2, "b": 0}
    assert {r[0]: r[1] for r in ins.missing_texts(df, "t", ["split"], blanks=False).collect()} == {"a": 1, "b": 0}
    counts = df.groupBy(F.col("split").alias("source")).agg(F.count("*").alias("n_rows"))
    status = ins.source_status(counts, ["a", "c", "d"], found=["a", "c"])
    assert {r["source"]: r["status"] for r in status.collect()} == {"a": "ok", "c": "empty", "d": "missing"}


def test_timing_statistics(spark):
    rng = random.Random(11)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "twenty": [float(i) for i in range(1, 21)],
        "two hundred": [float(i) for i in range(1, 201)], "hot value": [7.25] * 3000 + [1.0, 9.0],
        "large": [round(rng.expovariate(0.01), 2) for _ in range(20_001)], "negative": [-1.5, -2.5, 0.0, 4.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in timing_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, r = sorted(vs), got[g]
        assert r["n_measured"] == len(s) and (r["min_ms"], r["max_ms"]) == (s[0], s[-1])
        assert r["p95_ms"] == s[min(int(len(s) * 0.95), len(s) - 1)]
        assert r["median_ms"] == pytest.approx(statistics.median(s), abs=6e-4)
        assert r["mean_ms"] == pytest.approx(statistics.fmean(s), abs=6e-4)
    assert got["two hundred"]["p95_ms"] == 191.0


def test_repeated_ids_and_labels_without_end_are_refused(spark, monkeypatch):
    from reviewloom.operators import splitting

    rows = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0)], "id int, label int")
    for split in (splitting.stratified_split, splitting.stratified_sample, splitting.stratified_folds):
        with pytest.raises(ValueError, match="id 3 occurs 2 times"):
            split(rows)
    monkeypatch.setattr(splitting, "MOST_LABELS", 5)
    with pytest.raises(ValueError, match="more than 5 labels"):
        splitting.stratified_split(spark.createDataFrame([(i, i % 6) for i in range(20)], "id int, label int"))
