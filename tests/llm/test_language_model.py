"""Scores against a plain backoff model with dictionaries."""

import collections
import math
import zlib

import numpy as np
import pytest

from reviewloom.llm.common import table
from reviewloom.llm.key_exchange import exchange, by_chunk, answer_arrays, batches_of, run_rows, RUN
from reviewloom.llm.language_model import DISCOUNT, END, Chunk, hashed, pack_chunk, score_texts


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def plain(rows, least=2):
    train = [tokens(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(w for doc in train for w in doc)
    total, distinct = sum(count.values()), len(count)
    grams = {
        n: {g: c for g, c in collections.Counter(tuple(d[i : i + n]) for d in train for i in range(len(d) - n + 1)).items() if c >= least}
        for n in (2, 3)
    }
    count_of = lambda h: count[h[0]] if len(h) == 1 else grams[2][h]
    following = collections.defaultdict(list)
    for n in (2, 3):
        for g in grams[n]:
            following[g[:-1]].append(g[-1])

    def p(h, w):
        if not h:
            return (count[w] + 1) / (total + distinct + 1)
        if (*h, w) in grams.get(len(h) + 1, {}):
            return (grams[len(h) + 1][*h, w] - DISCOUNT) / count_of(h)
        if h not in following:
            return p(h[1:], w)
        given = sum(p(h, v) for v in following[h])
        below = sum(p(h[1:], v) for v in following[h])
        return max(1 - given, 1e-12) / max(1 - below, 1e-12) * p(h[1:], w)

    out = []
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        score = sum(math.log10(p(tuple(own[max(0, i - 2) : i]), w)) for i, w in enumerate(own))
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        out.append((d, held, len(own), sum(count[w] > 0 for w in own), total, base, score))
    return out, p, count


def close(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], r[5])) for x in (got, want))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:7] for r in want], rtol=1e-9, atol=1e-9)


def mixed_rows():
    rng = np.random.default_rng(6)
    words = ["The", "cat", "sat", "on", "É", "mat", "a", "dog", "ran"] + [f"w{i}" for i in range(60)]
    share = np.array([20.0] * 9 + [1.0] * 60)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 400)), p=share / share.sum()))) for i in range(40)]
    return [*rows, (40, None), (41, ""), (None, "The cat zzz"), (41, "a dog ran a dog ran"), (42, "the cat sat " * 3000)]


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 300, "fan_in": 3, "step": 10}, {"chunk_bytes": 2000, "least": 4, "step": 1}])
def test_equal_to_plain_model(spark, settings):
    rows = mixed_rows()
    want, p, count = plain(rows, settings.get("least", 2))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, blob string, node int").repartition(3)
    got = [tuple(r) for r in score_texts(df, **settings).collect()]
    # Held-out is false for a null id, which is not learned from either.
    close(got, want)
    vocabulary = [*count, b"never seen"]
    for h in [(), (b"the",), (b"the", b"cat"), (b"w1", b"dog")]:
        assert abs(sum(p(h, w) for w in vocabulary) - 1) < 1e-9
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_chunks")]


def test_table_and_empty(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want, *_ = plain([(r.doc_id, r.text) for r in docs.collect()])
    close([tuple(r) for r in score_texts(docs).collect()], want)
    assert score_texts(docs.limit(0)).count() == 0
    held = docs.where("crc32(cast(doc_id as string)) % 7 = 2")
    want, *_ = plain([(r.doc_id, r.text) for r in held.collect()])
    close([tuple(r) for r in score_texts(held).collect()], want)


def test_repeated_grams_count_in_a_large_corpus(spark):
    """A pair and a triple that occur twice in 300,000 tokens, a share below 1e-5."""
    rows = [(i, "x y " * 1000) for i in range(170)] + [(1000 + i, "rare word here") for i in (1, 2)] + [(2000, "rare here word")]
    want, *_ = plain(rows)
    close([tuple(r) for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_bytes=20_000).collect()], want)


def test_chunks_hold_their_texts():
    texts = [b"A b a b", b"", b"b a", "É é É".encode()]
    chunk = Chunk(pack_chunk(texts, np.array([True, True, False, True])))
    ends = np.cumsum(chunk.lengths)
    assert [chunk.words[chunk.tokens[e - n : e]].tolist() for n, e in zip(chunk.lengths, ends)] == [hashed(t).tolist() for t in texts]
    assert hashed(b"A a")[0] == hashed(b"a")[0] and END in chunk.words
    words, pairs = chunk.own_counts()
    assert words.sum() == 10 and pairs.sum() == 4 + 0 + 3


@pytest.mark.parametrize(("fan_in", "step"), [(1000, 1 << 18), (4, 1 << 18), (2, 7)])
def test_exchange_equals_plain_sums(spark, fan_in, step):
    rng = np.random.default_rng(2)
    chunks = {}
    for node in range(9):
        keys = np.unique(np.concatenate([rng.integers(0, 1 << 56, 50), rng.integers(0, 40, 30), [7, (1 << 56) - 1, 0]]))
        chunks[node] = {1: (keys, rng.integers(0, 5, (len(keys), 2))), 2: (keys[:3], np.ones((3, 2), int))}
    rows = [r for node, own in chunks.items() for space, (k, v) in own.items() for r in run_rows(node, space, k, v)]
    runs = spark.createDataFrame([(a, b, c, d, bytearray(e)) for a, b, c, d, e in rows], RUN).repartition(4)
    got = {r.node: answer_arrays([x.asDict() for x in r.x]) for r in by_chunk(exchange(runs, 9, lambda s, v: v * s, "test", fan_in, step), "x").collect()}
    total, owners = collections.defaultdict(lambda: np.zeros(2, int)), collections.Counter()
    for own in chunks.values():
        for space, (keys, values) in own.items():
            for k, v in zip(keys.tolist(), values, strict=True):
                total[space, k] = total[space, k] + v
    for node, own in chunks.items():
        for space, (keys, _) in own.items():
            assert np.allclose(got[node][space][:, :2], [total[space, k] * space for k in keys.tolist()])
            owners.update((space, k) for k, o in zip(keys.tolist(), got[node][space][:, 2]) if o)
    assert set(owners) == set(total) and set(owners.values()) == {1}
    assert list(batches_of(iter([]))) == []
