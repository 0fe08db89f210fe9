"""Alignment against whole-text encoding and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm.common import table
from reviewloom.llm.token_alignment import BYTE_FILE, FOLDER, PIECE_FILE, Aligner, align_tokenizers, byte_alphabet

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/{BYTE_FILE}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{FOLDER}/{PIECE_FILE}")


def spans(parts):
    out, at = [], 0
    for token, x in parts:
        out.append((at, at + len(x), token))
        at += len(x)
    return out


def plain_text(text, tools):
    """(groups spelled, links) of one text, by comparing byte ranges."""
    if not text:
        return None
    a, b = tools
    alphabet = byte_alphabet()
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return None
    left, right = spans(left), spans(right)
    both = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    groups, start = [], 0
    for end in both:
        groups.append("|".join(",".join(str(t) for s, e, t in side if s >= start and e <= end) for side in (left, right)))
        start = end
    links = [(x, y) for s, e, x in left for p, q, y in right if s < q and p < e]
    return len(left), len(right), groups, links


def plain(rows, tools):
    found = [(i, plain_text(t, tools)) for i, t in rows]
    count = Counter(p for _, f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


def odd_texts():
    rng = np.random.default_rng(3)
    letters = list("abcdeth inou   \n\t.,'é½²中あ🙂́  \x1c\x85▁<s>|0123") + ["'ll", " the", "tion", "<|endoftext|>", "  ", "\r\n"]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(400)]
    return [*texts, None, "", " ", "  ", " a", "a ", "a  b", "▁", "x" * 3000, " " * 500, "same text", "same text", "ab " * 2000]


def rows_of(df):
    return sorted(((r.doc_id, *[r[c] for c in COLUMNS[1:]]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r))


def test_stretches_equal_whole_texts(tools):
    aligner = Aligner(FOLDER)
    assert aligner.apart
    texts = odd_texts()
    for part in (texts[:250], texts[200:]):
        rows, spelled, pairs, slots = aligner.texts(part)
        for i, text in enumerate(part):
            want = plain_text(text, tools)
            if want is None:
                assert rows[i].tolist() == [0] * 4 and spelled[i] == ""
                continue
            assert rows[i].tolist() == [want[0], want[1], len(want[2]), len(want[3])], text
            assert spelled[i] == ";".join(want[2])
            assert sorted((int(p) >> 16, int(p) & 0xFFFF) for p in pairs[slots == i]) == sorted(want[3])


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 300, "radixes": 3, "fan_in": 4, "step": 50}, {"chunk_bytes": 2000, "fan_in": 1000, "step": 1}])
def test_counts_equal_plain(spark, tools, settings):
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(odd_texts())]
    rows.append((7, "same text", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long").repartition(3)
    want = sorted(plain([(r[0], r[1]) for r in rows], tools), key=lambda r: (r[0] is not None, r[0] or 0, r))
    got = align_tokenizers(docs, **settings)
    assert got.columns == COLUMNS
    assert rows_of(got) == want


def test_table_and_empty(spark, tools):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 1500]
    some = docs.where("coalesce(length(text), 0) < 1500")
    assert rows_of(align_tokenizers(some, chunk_bytes=20_000)) == sorted(plain(rows, tools))
    assert align_tokenizers(docs.limit(0)).count() == 0
