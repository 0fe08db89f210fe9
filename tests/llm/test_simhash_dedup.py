"""SimHash links against brute force over all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewloom.llm import simhash_dedup
from reviewloom.llm.common import table
from reviewloom.llm.simhash_dedup import (
    keep_first, link_forest, shared_counts, shingle_fingerprint, shingle_set, similar_components, simhash_components, verified,
    word_hashes,
)


def union(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "  \n", "one", "ONE", "one two three", "Ä ä\x0bb\x1cc d e"]
    base = [" ".join(rng.choice(["alpha", "beta", "gam", "del", "eps", "zeta", "eta"], 60)) for _ in range(25)]
    for text in base:
        words = text.split()
        texts += [text, text, " ".join(words[:-1]), " ".join([*words, "new"]), " ".join(["x", *words[1:]])]
    texts.append("long " * 30_000)
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, fp int")
    got = {r.doc_id: r for r in simhash_components(df).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = union(prints, links)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_blocks_of_heavy_values_lose_no_link(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    values = {center}
    while len(values) < 150:
        values.add(center ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(v, v) for v in values], "node long, fp long")
    whole = link_forest(df, ["fp"], [(0, 0, 22), (0, 22, 21), (0, 43, 21)], ["fp"], 4).collect()
    cut = link_forest(df, ["fp"], [(0, 0, 22), (0, 22, 21), (0, 43, 21)], ["fp"], 4, group_rows=20).collect()
    assert union(values, whole) == union(values, cut)
    assert len(set(union(values, cut).values())) == 1


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.component_id) for r in simhash_components(df).collect()], key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]
    assert simhash_components(df.limit(0)).count() == 0


def test_similar_documents_meet_and_others_stay(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    rows, pairs = [], 0
    for i in range(60):
        words = rng.choice(vocabulary, 300).tolist()
        near = list(words)
        near[100 + i] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(60))
    assert pairs >= 57
    assert all(got[2 * i] == 2 * i for i in range(60))


def test_fingerprint_of_few_words():
    assert shingle_fingerprint(b"", 4, 42) == 0
    assert shingle_fingerprint(b"A b", 4, 42) == xxhash.xxh64_intdigest(b"a b", 42)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "a"), (2, text.upper(), "b"), (2, text, "c"), (9, "other words", "d"), (None, None, "e"), (None, "", "f"), (4, "other  words", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = keep_first(df, similar_components(df)).collect()
    assert sorted([r.doc_id for r in kept], key=str) == [2, 4, None]
    assert {r.root for r in kept} <= {"b", "c", "g", "e", "f"}


def word_sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]


def test_links_are_exact_similarities_on_both_sides(spark):
    """Groups of texts around the similarity of 0.8: joined at or above it, apart below."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    texts = []
    for i in range(120):
        words = rng.choice(vocabulary, 450).tolist()
        near = list(words)
        for at in np.linspace(5, 440, 9 + i % 4).astype(int):  # similarities of 0.82, 0.80, 0.78, 0.76
            near[at] = "changed"
        texts += [" ".join(words), " ".join(near)]
    sets = word_sets(texts)
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 240, 2)]
    assert {x >= 0.8 for x in alike} == {True, False}
    joined = [got[2 * i + 1] == 2 * i for i in range(120)]
    assert not [x for x, j in zip(alike, joined) if j and x < 0.8]
    assert sum(j for x, j in zip(alike, joined) if x >= 0.8) >= 0.95 * sum(x >= 0.8 for x in alike)


def sets_of(texts):
    return [shingle_set(word_hashes(t.encode()), 5) for t in texts]


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def test_short_texts_keep_their_order():
    a, b, c, d = sets_of(["a b c d e", "e d c b a", "a b", "b a"])
    assert not len(np.intersect1d(a, b)) and not len(np.intersect1d(c, d)) and len(a) == len(c) == 1
    assert np.array_equal(*sets_of(["A  b", "a b"])) and not len(sets_of([""])[0])


def near_copies(rng, n, words=120, changed=9):
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    base = rng.choice(vocabulary, words).tolist()
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.choice(words, int(rng.integers(0, changed))):
            own[at] = f"x{rng.integers(0, 60)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("common", [0, 5, 1000])
def test_shared_counts_equal_set_intersections(monkeypatch, common):
    monkeypatch.setattr(simhash_dedup, "COMMON", common)
    sets = sets_of([*near_copies(np.random.default_rng(3), 60), "", "one", "one two"])
    left, right = sets[:40], sets[25:]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert shared_counts(left, right).astype(int).tolist() == want


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("settings", [{}, {"block_shingles": 3000, "broadcast_keys": 0}])
def test_every_link_of_a_large_group_counts_and_pairs_stay_inside(spark, settings):
    """One group around the similarity of 0.8: the components of all links, from few rows."""
    texts = near_copies(np.random.default_rng(5), 250)
    sets = sets_of(texts)
    rows = [(i, i, len(s), t) for i, (s, t) in enumerate(zip(sets, texts, strict=True))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    nodes = spark.createDataFrame(rows, "node long, low long, n long, text string").select("node", "n", F.xxhash64("text").alias("text_key"))
    candidates = spark.createDataFrame([(i, i + 1) for i in range(249)], "a long, b long")
    found = [tuple(r) for r in verified(candidates, nodes, docs, 5, 0.8, **settings).collect()]
    want = [(a, b) for a in range(250) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in found)
    assert components_of(250, found) == components_of(250, want)
    assert len(want) > 1000 and len(found) < 250 * 12


def links_of(sets, similarity):
    """All pairs of sets at or above a similarity, found through the shingles they share."""
    holders: dict = {}
    for i, own in sets.items():
        for x in own.tolist():
            holders.setdefault(x, []).append(i)
    near = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    return [(a, b) for a, b in near if jaccard(sets[a], sets[b]) >= similarity]


def test_recall_of_links_on_the_corpus(spark):
    """All pairs of documents with a similarity of 0.8: both end in one group."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    group = {r.doc_id: r.root for r in similar_components(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {d: s for d, s in zip(texts, sets_of(list(texts.values())), strict=True) if len(s)}
    pairs = links_of(sets, 0.8)
    assert len(pairs) > 40
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.95 * len(pairs)
