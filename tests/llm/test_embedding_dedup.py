"""Vector links against all pairs in double precision."""

import numpy as np
import pytest

from reviewloom.llm.common import table
from reviewloom.llm.embedding_dedup import vector_components


def plain(rows, cosine=0.98):
    good = []
    for i, (_, e, label) in enumerate(rows):
        x = np.array(e if e and None not in e else [0.0], float)
        if label is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            good.append((i, x, label))
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p, (i, x, label) in enumerate(good):
        for j, y, other in good[p + 1 :]:
            if label == other and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                degree[i] += 1
                degree[j] += 1
                parent[find(j)] = find(i)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(x for x in (low.get(find(i), 1 << 60), 1 << 60 if r[0] is None else r[0]))
    out = []
    for i, r in enumerate(rows):
        component = low[find(i)] if low[find(i)] < 1 << 60 else None
        out.append((r[0], degree[i], component, r[0] == component))
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"


def got(df, **settings):
    return sorted((tuple(r) for r in vector_components(df, **settings).collect()), key=repr)


def clustered():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        center = np.random.default_rng(i % 40).normal(size=8)
        x = center + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.15, 0.4])
        rows.append((i, x.astype(np.float32).tolist(), i % 3))
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0, None] + [0.0] * 6, 1), (403, [float("nan")] * 8, 0), (404, rows[0][1], None)]
    rows += [(405, [], 0), (406, [1.0, 2.0], 0), (407, [1.0, 2.0], 0), (3, rows[3][1], rows[3][2]), (None, rows[4][1], rows[4][2]), (None, None, None)]
    rows += [(408, [x * 1e30 for x in rows[5][1]], rows[5][2]), (409, [float("inf")] * 8, 0)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 20, "pivots": 5}, {"cell_rows": 30, "pivots": 1}, {"pivots": 0}])
def test_equal_to_all_pairs(spark, settings):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as node", "2 as unit")
    assert got(df, **settings) == plain(rows)


def test_table_and_empty(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in vectors.collect()]
    assert got(vectors) == plain(rows)
    assert vector_components(vectors.limit(0)).count() == 0


def test_no_group_is_larger_than_two_blocks(spark, monkeypatch):
    """Also where nearly all vectors are copied to the first cells."""
    from pyspark.sql.group import GroupedData

    sizes, apply = [], GroupedData.applyInPandas

    def counting(self, *settings):
        sizes.extend(r["count"] for r in self.count().collect())
        return apply(self, *settings)

    monkeypatch.setattr(GroupedData, "applyInPandas", counting)
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(rng.normal(size=(600, 24)).astype(np.float32))]
    assert got(spark.createDataFrame(rows, SCHEMA), cosine=0.9, cell_rows=40, pivots=6) == plain(rows, 0.9)
    assert max(sizes) <= 2 * 40 * 1.6  # blocks are dealt by a hash
