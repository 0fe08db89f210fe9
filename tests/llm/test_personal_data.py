"""Pattern spans against plain regular expressions, the random field against enumeration."""

import hashlib
import itertools
import re

import numpy as np

from reviewloom.llm.common import table
from reviewloom.llm.personal_data import (
    KINDS, all_spans, apart, base_spans, best_path, find_personal_data, fit_field, luhn, mask, respelled, segments, train,
)

SF = "/root/testdata/sf0.01"


def plain(text):
    def take(pattern, good):
        return [m.span() for m in re.finditer(pattern, text) if good(m.group())]

    digits = lambda s: re.sub("[^0-9]", "", s)
    return [
        take(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        take(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        take(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        take(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]


def test_patterns_equal_plain_regex():
    rng = np.random.default_rng(4)
    alphabet = list("0123456789") * 2 + list(".@+- ()ab_%é\n") * 2
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 60))))
        assert base_spans(text) == plain(text), text
    for text in ("a@b.c@d.e x@@y.z a..b@-.-", "1.2.3.4.5.6.7.8 0256.1.1.1 000255.1.1.1", "+1 (017) 555-7713", "4111 1111-1111 1111"):
        assert base_spans(text) == plain(text)


def examples():
    rows = []
    for i in range(150):
        text = f"hein ti mail{i}.x@host{i % 7}.example.com and {10 + i}.2.3.{i % 250} or +1 (2{i % 10}3) 555-0{100 + i} end {i * 7919} ref 7{i:015d} z"
        truth = apart(base_spans(text))
        rows += [(text, truth), respelled(text, truth, i)]
    return rows


def test_best_path_equals_enumeration():
    weights = fit_field(examples(), rounds=2)
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = "".join(rng.choice(["12", "345", ".", " ", "-", "+", "(", ")", "4111", "@", "ab"], 6))
        bounds, ends = segments(text, 0, len(text))
        rows = [(i, e, k, float(weights[f].sum())) for e, own in enumerate(ends) for i, k, f in own]
        best = 0.0
        for n in range(1, 4):
            for some in itertools.combinations(rows, n):
                order = sorted(some)
                if all(x[1] <= y[0] for x, y in itertools.pairwise(order)):
                    best = max(best, sum(x[3] for x in some))
        place = {b: i for i, b in enumerate(bounds)}
        got = sum(next(s for i, e, k, s in rows if (i, e, k) == (place[a], place[b], kind)) for kind, a, b in best_path(text, 0, len(text), weights))
        assert abs(got - best) < 1e-9


def test_field_adds_respelled_spans_and_keeps_base():
    weights = fit_field(examples())
    base, whole = all_spans("write joe@a.example.com or kim at mail5 dot example dot com or 10[.]2[.]3[.]44 or (213) 555-0144 ok", weights)
    assert all(set(b) <= set(w) for b, w in zip(base, whole, strict=True))
    assert [len(w) for w in whole] == [2, 1, 0, 1]
    for clean in ("nothing here", "in 2024 we sold 1 200 300 units", "version 1.2.3", "see pages 12-19, 44", "look at this"):
        assert not any(all_spans(clean, weights)[1]), clean


def test_tables_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    weights = train(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in find_personal_data(docs, weights).collect():
        spans = plain(texts[r.doc_id])
        spelled = ",".join(f"{KINDS[k]}:{a}:{b}" for k, own in enumerate(spans) for a, b in own)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans]
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(spelled.split(",")) - {""} <= set(r.spans.split(","))
    rows = [(1, None, 3, "e"), (None, "", 0, "e"), (2, "é a@b.cd +1 (017) 555-7713", 26, "e"), (2, "1 " * 200_000, 400_000, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.base_sha256): r for r in find_personal_data(odd, weights).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, empty) in got and (None, empty) in got
    assert got[2, hashlib.sha256(b"email:2:8,phone:9:26").hexdigest()].spans == "email:2:8,phone:9:26"
    hidden = {r.text: r for r in mask(odd, weights).collect()}
    assert hidden["é [EMAIL] [PHONE]"].n_chars == 17 and hidden[None].n_chars == 3
    assert mask(odd, weights).columns == odd.columns
    assert find_personal_data(odd.limit(0), train(odd.limit(0))).count() == 0


def test_long_texts_of_spans_take_time_in_proportion():
    """Addresses without end: the same spans as piece by piece, in seconds and not hours."""
    import time

    weights = fit_field(examples())
    line = "write joe.x@a.example.com or (213) 555-0144 or kim at mail5 dot example dot com ok\n"
    base, whole = all_spans(line, weights)
    took = []
    for n in (400, 1600):
        start = time.perf_counter()
        many = all_spans(line * n, weights)
        took.append(time.perf_counter() - start)
        for own, found in zip((*base, *whole), (*many[0], *many[1]), strict=True):
            assert found == [(a + i * len(line), b + i * len(line)) for i in range(n) for a, b in own]
    assert took[1] < 8 * took[0] + 1
