"""The set-similarity join against all pairs of blocks and templates, phrases against plain search."""

import re

import numpy as np
import pytest

from reviewloom.llm.common import table
from reviewloom.llm.license_scan import PHRASES, STEP, TEMPLATES, block_starts, license_blocks, scan_licenses, template_words


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_blocks(rows, templates, threshold, step):
    found = []
    for i, text in rows:
        own = words(text)
        for start in range(0, len(own), step):
            if start and start + step >= len(own):
                break
            block = set(own[start : start + 2 * step])
            for t, (label, notice) in enumerate(templates):
                wanted = set(words(notice))
                if len(block & wanted) >= threshold * len(wanted) - 1e-9:
                    found.append((i, start, t, label, round(len(block & wanted) / len(wanted), 9)))
    return sorted(found)


def plain_phrases(text):
    own, found = words(text), []
    for phrase, label in PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(own)) if own[i : i + len(parts)] == parts]
    return own, found


def made_rows():
    rng = np.random.default_rng(5)
    filler = ["the", "of", "under", "license", "this", "work", "by", "cc", "4", "0", "foo", "éa", "all", "rights", "reserved", "general", "public", "version"]
    rows = []
    for i in range(300):
        own = list(rng.choice(filler, int(rng.integers(0, 200))))
        if i % 3 == 0:
            notice = TEMPLATES[i // 3 % len(TEMPLATES)][1].split()
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = [w for w in notice if rng.random() > 0.15]
        rows.append((i, str(rng.choice([" ", "\n", ", ", "-"])).join(own)))
    return [*rows, (300, None), (300, ""), (None, "CC BY-NC, All Rights  reserved. all rights reserved"), (301, "cc BY " * 50_000), (302, "ÉCC by ccby cc.by")]


@pytest.mark.parametrize(("threshold", "step"), [(0.8, STEP), (0.5, 25), (1.0, STEP), (0.05, 30)])
def test_join_equals_all_pairs(spark, threshold, step):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(4)
    got = license_blocks(docs, threshold=threshold, step=step).collect()
    assert sorted((r.doc_id, r.first_word, r.template, r.label, round(r.containment, 9)) for r in got if r.doc_id is not None) == \
        plain_blocks([r for r in rows if r[0] is not None], TEMPLATES, threshold, step)


def test_scan_equals_plain(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        own, base = plain_phrases(text)
        matched = plain_blocks([(0, text)], TEMPLATES, 0.8, STEP)
        want = (
            len(own), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {m[3] for m in matched})),
            1.0 if base else max((m[4] for m in matched), default=0.0),
        )
        assert any(tuple(r)[1:7] == want[:6] and abs(r.score - want[6]) < 1e-9 for r in got[i]), (i, want)
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices_of_the_corpus_and_clean_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    notice = docs.where("text rlike 'Apache License, Version 2|under the MIT License|GNU General Public|CC BY-NC'").select("doc_id")
    found = scan_licenses(docs).where("labels <> ''")
    assert notice.count() > 3 and notice.join(found, "doc_id", "left_anti").count() == 0
    # Nothing is found in texts without any notice.
    assert found.join(docs.where("not lower(text) rlike 'licen|rights|cc by'"), "doc_id", "left_semi").count() == 0


def test_templates_are_checked():
    assert [len(block_starts(n, 40)) for n in (0, 40, 80, 81, 120, 121)] == [1, 1, 1, 2, 2, 3]
    for bad in ([("x", "")], [("x", "a " * 41)]):
        with pytest.raises(ValueError, match="template"):
            template_words(bad, 40)
