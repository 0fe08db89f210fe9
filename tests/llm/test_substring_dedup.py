"""Repeated passages against a plain dictionary of windows."""

import numpy as np
import pytest

from reviewloom.llm.common import table
from reviewloom.llm.substring_dedup import remove_repeats


def plain(rows, window=20):
    """rows: (doc_id, text) in order; kept text of each."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return out


def by_id(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"broadcast_rows": 0}, {"group_suffixes": 40}])
def test_equal_to_dictionary(spark, settings):
    rng = np.random.default_rng(8)
    passage = [" ".join(rng.choice(["a", "b", "c", "dd", "e"], n)) for n in (20, 25, 60, 19)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice([f"u{k}" for k in range(400)], int(rng.integers(0, 40)))) for _ in range(3)]
        parts.insert(1, passage[i % 4])
        rows.append((i * 2, "  \n".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "w " * 300), (503, "w " * 19), (504, None), (505, ""), (506, passage[3])]
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, row long").repartition(5)
    want = sorted(((d, *p) for (d, _), p in zip(rows, plain(rows), strict=True)), key=repr)
    assert by_id(remove_repeats(df, **settings)) == want


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted(((d, *p) for (d, _), p in zip(rows, plain(rows), strict=True)), key=repr)
    assert sum(w[2] for w in want) > 0
    assert by_id(remove_repeats(docs)) == want


def test_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(4, text), (4, text), (None, text + " z"), (2, text)], "doc_id long, text string")
    got = by_id(remove_repeats(df))
    assert got == sorted([(4, 30, 30, ""), (4, 30, 30, ""), (None, 31, 0, text + " z"), (2, 30, 30, "")], key=repr)
    assert remove_repeats(df.limit(0)).count() == 0
