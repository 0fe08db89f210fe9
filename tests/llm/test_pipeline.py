"""Every stage of the pipeline on its own input, against plain versions."""

import numpy as np
import pytest

import corpus_pipeline
from reviewloom.llm.common import table
from reviewloom.llm.decontamination import build, matches, normal
from reviewloom.llm.packing import SIZES
from reviewloom.llm.personal_data import base_spans
from reviewloom.llm.quality import fit_quality, statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first and after every stage."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def test_columns(stages):
    for df in stages[:5]:
        assert df.columns == stages[0].columns


def test_quality(spark, stages):
    trees = fit_quality(stages[0], table(spark, SF, "labels"))
    before = texts(stages[0])
    good = {d for d, t in before.items() if trees.scores(np.array([statistics((t or "").encode())]))[0] >= 0.5}
    assert texts(stages[1]) == {d: before[d] for d in good} and good != set(before)


def test_near_duplicates(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {d: shingles(t) for d, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(before[d] == t for d, t in after.items())
    kept = sorted(after)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if alike(a, b) >= 0.8]
    for gone in set(before) - set(after):
        assert max(alike(gone, d) for d in before if d != gone) >= 0.8


def test_decontamination(spark, stages):
    sets = build([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    before = texts(stages[2])
    clean = {d for d, t in before.items() if not matches(normal((t or "").encode()), sets)}
    assert set(texts(stages[3])) == clean


def test_personal_data(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for d, t in after.items():
        assert not any(base_spans(t or ""))
        if t != before[d]:
            assert any(f"[{k}]" in t for k in ("EMAIL", "IP", "CARD", "PHONE"))
    assert all(r.n_chars == len(r.text) for r in stages[4].collect() if r.text is not None and r.text != before[r.doc_id])


def test_packing_holds_every_token(stages):
    tokens = {d: len((t or "").encode().split()) + 1 for d, t in texts(stages[4]).items()}
    rows = stages[5].collect()
    got: dict = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.bin_used <= r.bin_size and r.bin_size in SIZES and r.offset + r.length <= r.bin_used
    assert got == tokens


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == stages[5].columns and found.count() == stages[5].count()


def odd_documents(spark):
    text = " ".join(f"w{i} of the plain text number {i}." for i in range(30))
    rows = [
        (1, text, "en", "web", len(text), "x", 5), (1, text, "en", "web", len(text), "x", 5), (2, text, None, None, None, None, None),
        (None, text + " more", "en", "web", 3, "y", 6), (3, None, "en", "web", 0, "z", 7), (4, "", "en", "web", 0, "z", 7),
        (5, "mail a.b@example.com now " * 4000, "en", "web", 0, "z", 8), (6, "word " * 60_000, "en", "web", 0, "z", 8), (7, "e d c b a", "en", "web", 9, "z", 9),
        (8, "a b c d e", "en", "web", 9, "z", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string, component_id int")


def test_odd_rows_pass_every_stage(spark):
    """Nulls, repeats, empty and long texts, and columns named like those of the operators."""
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            kept = [r.doc_id for r in rows]
            # One row of the three copies; the empty and the null text are one group; word order counts.
            assert sorted(kept, key=str) == sorted([1, 3, 5, 6, 7, 8], key=str)
        if name == "personal_data":
            assert {r.doc_id: r.text for r in rows}[3] is None and len(rows) == 10
        if name == "packing":
            assert sum(r.length for r in rows) == sum(len((r.text or "").split()) + 1 for r in docs.collect())


def test_empty_table_passes_every_stage(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
