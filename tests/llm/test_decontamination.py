"""Benchmark passages against a plain edit-distance search."""

import numpy as np
from pyspark.sql import functions as F

from reviewloom.llm.common import table
from reviewloom.llm.decontamination import align, build, candidates, contaminated, drop_contaminated, grams, matches, normal

SF = "/root/testdata/sf0.01"


def best_distance(text, pattern):
    """Edits between the whole pattern and its best piece of the text (full table)."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.minimum(np.concatenate(([i], row[:-1] + (text != c))), row + 1)
        for j in range(1, len(new)):
            new[j] = min(new[j], new[j - 1] + 1)
        row = new
    return row.min()


def test_every_pattern_within_the_budget_is_found():
    rng = np.random.default_rng(1)
    letters = "abcdefgh "
    for trial in range(12):
        pattern = "".join(rng.choice(list(letters), 100)).strip()
        p = build([(1, pattern)])[0]
        edited = list(pattern)
        for _ in range(trial):
            k = int(rng.integers(0, len(edited)))
            kind = rng.integers(0, 3)
            edited[k : k + 1] = [] if kind == 0 else ["x"] if kind == 1 else [edited[k], "y"]
        text = normal(("".join(rng.choice(list(letters), 400)) + " " + "".join(edited) + " " + "".join(rng.choice(list(letters), 300))).encode())
        want = {a for a, codes in enumerate(p.codes) if best_distance(text, codes) <= p.edits[a]}
        got = {a for a, low, width in candidates(text, p) if align(text, p.codes[a], low, width, int(p.edits[a]))}
        assert got == want


def test_whole_items_of_the_tables(spark):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    squeeze = lambda t: " ".join((t or "").split()).lower()
    texts = {r.doc_id: squeeze(r.text) for r in docs.collect()}
    items = {r.item_id: squeeze(r.text) for r in benchmark.collect()}
    want = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    assert want and want <= got
    kept = {r.doc_id for r in drop_contaminated(docs, benchmark).collect()}
    assert kept == set(texts) - {d for d, _ in got}
    # Whatever else is reported really is close to a part of the item.
    for d, i in got - want:
        text = normal(texts[d].encode())
        assert any(best_distance(text, codes) <= e for p in build([(i, items[i])]) for codes, e in zip(p.codes, p.edits, strict=True))


def test_odd_rows(spark):
    passage = "an item long enough to be cut into patterns of its own " * 3
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, f"x {passage}", 0), (3, "filler " * 300_000 + passage, 0), (3, "say xyz now", 0), (4, "clean", 0)],
        "doc_id long, text string, item_id int",
    )
    benchmark = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "xyz")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    assert got == {(None, 1), (3, 1), (3, 4)}
    assert {r.doc_id for r in drop_contaminated(docs, benchmark).collect()} == {1, 2, 4}
    for kind in ("int", "string", "double"):
        typed = contaminated(docs, benchmark.withColumn("item_id", F.col("item_id").cast(kind)))
        assert typed.schema["item_id"].dataType.simpleString() == kind and typed.count() == 3
    assert contaminated(docs, benchmark.limit(0)).count() == 0 and contaminated(docs.limit(0), benchmark).count() == 0


def test_grams_and_long_text_chunks():
    codes = normal("aB  c\x0bdefgh".encode())
    assert bytes(codes.astype(np.uint8)) == b"ab c defgh" and len(grams(codes, 8)) == 3
    p = build([(9, "the quick brown fox jumps over the lazy dog and runs away from all of it again, quickly")])
    text = np.concatenate([normal(b"filler " * 149_790), p[0].codes[0]])
    assert [m[0] for m in matches(text, p)] == [9]
