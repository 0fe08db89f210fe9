"""Boosted trees against plain references, held-out accuracy, odd rows."""

import numpy as np

from reviewloom.llm.common import table
from reviewloom.llm.quality import FEATURES, fit_quality, fit_trees, keep_good, quality_scores, statistics

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    trees = fit_quality(docs, labels)
    scored = quality_scores(docs, trees).join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() == quality_scores(docs, trees).count()
    assert (scored.predicted == scored.quality).mean() >= 0.95
    low, high = scored[scored.quality == 0].score, scored[scored.quality == 1].score
    assert (high.to_numpy()[:, None] > low.to_numpy()[None, :]).mean() >= 0.97


def test_walk_equals_plain_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = fit_trees(x, y, rounds=30)
    inner = trees.feature.shape[1]

    def walk(row):
        margin = trees.bias
        for t in range(len(trees.feature)):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
            margin += trees.leaf[t, node - inner]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(trees.scores(x), [walk(r) for r in x])
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.98


def test_no_example_and_one_class():
    none = fit_trees(np.zeros((0, 3)), np.zeros(0))
    assert none.scores(np.ones((2, 3))).tolist() == [0.5, 0.5]
    one = fit_trees(np.ones((9, 3)), np.ones(9))
    assert (one.scores(np.ones((1, 3))) > 0.9).all()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "some words here", "z"), (3, "word " * 200_000, "w"), (3, "word " * 200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    trees = fit_quality(docs, labels)
    got = quality_scores(docs, trees).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert keep_good(docs, trees).columns == ["doc_id", "text", "score"]
    assert quality_scores(docs.limit(0), fit_quality(docs.limit(0), labels.limit(0))).count() == 0


def test_statistics_of_a_text():
    got = dict(zip(FEATURES, statistics(b"Ab cd! ab\nAb cd! ab | 12"), strict=True))
    assert got["distinct_lines"] == 1.0 and got["digits"] == 2 / 24 and got["bars"] == 1 / 8 and got["exclaims"] == 2 / 8
