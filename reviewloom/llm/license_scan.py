"""License notices in texts: fixed phrases, and an exact set-similarity join with notice templates.

A text block is a window of ``2 * step`` words that starts at every ``step``-th word of a
text (the last one ends with the text), so a notice of up to ``step`` words lies whole in
one block wherever it stands. A block matches a template if it holds at least
``threshold`` of the template's distinct words. All matching (block, template) pairs are found:

- words are ordered by the number of documents that hold them (whole corpus, rarest first);
- prefix filter: with overlap ``need = ceil(threshold * |T|)``, a match shares a word among the
  first ``|T| - need + 1`` of the template and the first ``|B| - need + 1`` of the block;
- length filter: the block has at least ``need`` words that occur in templates;
- positional filter: from the first shared word on, both must have enough words left.

Words that occur in no template cannot add to an overlap, so blocks are reduced to template
words first; the order then needs the counts of these words alone. The templates are a
parameter, checked to hold at most ``MOST_WORDS`` words together; they go to the tasks, and
the corpus stays where it is: one pass counts, one joins, and only word counts are shuffled.

Rows: a null or empty text has no words (no places, null ``first_word``, empty labels,
score zero); every row is judged by itself, repeated or null ids included; extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import byte_column

# Phrases that always count, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices as they are commonly written, and the label of each.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is distributed under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights under CC0"),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
)

#: Words in UTF-8 after lower-casing: digits, letters, and every byte of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
THRESHOLD, STEP, MOST_WORDS = 0.8, 40, 200_000


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def template_words(templates: Sequence[tuple[str, str]], step: int) -> list[tuple[str, list[bytes]]]:
    """(label, distinct words) of each template; refuses empty, too long or too many ones."""
    out = []
    for label, text in templates:
        words = words_of(text.encode())
        if not 0 < len(words) <= step:
            raise ValueError(f"a template has 1 to {step} words, this one {len(words)}: {text!r}")
        out.append((label, sorted(set(words))))
    if sum(len(w) for _, w in out) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} template words; scan with parts of the templates")
    return out


def document_counts(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each wanted word, over all documents."""

    def work(batches):
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in byte_column(batch, "text"):
                total.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "word binary, n long")
    # At most one row for each template word.
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Index:
    """Templates as rising ranks (rarest word first), and the prefixes they are found by."""

    rank: dict[bytes, int]
    templates: list[tuple[str, list[int], int]]
    prefix: dict[int, list[tuple[int, int]]]


def build_index(templates: Sequence[tuple[str, list[bytes]]], counts: dict[bytes, int], threshold: float) -> Index:
    words = sorted({w for _, own in templates for w in own}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    held, prefix = [], {}
    for t, (label, own) in enumerate(templates):
        ranks = sorted(rank[w] for w in own)
        # Rounded first: 0.8 * 5 is four words, whatever the last bit says.
        need = max(1, math.ceil(round(threshold * len(ranks), 9)))
        held.append((label, ranks, need))
        for place, r in enumerate(ranks[: len(ranks) - need + 1]):
            prefix.setdefault(r, []).append((t, place))
    return Index(rank, held, prefix)


def block_starts(n_words: int, step: int) -> range:
    """First words of the blocks of a text."""
    return range(0, max(1, n_words - step), step)


def join_block(block: list[int], index: Index) -> list[tuple[int, int]]:
    """(template, shared words) of every template the block matches; ``block``: rising distinct ranks."""
    size, tried, out = len(block), set(), []
    for at, r in enumerate(block):
        for t, place in index.prefix.get(r, ()):
            if t in tried:
                continue
            _, ranks, need = index.templates[t]
            # The first shared word within the template's prefix decides: rarer ones are not shared.
            tried.add(t)
            if size < need or at > size - need or min(len(ranks) - place, size - at) < need:
                continue
            shared = len(set(ranks).intersection(block))
            if shared >= need:
                out.append((t, shared))
    return out


def matches(words: list[bytes], index: Index, step: int) -> list[tuple[int, int, float]]:
    """(first word of the block, template, containment) of every match of a text."""
    ranks = [index.rank.get(w, -1) for w in words]
    known = [(i, r) for i, r in enumerate(ranks) if r >= 0]
    # Only blocks that hold a word of some template's prefix can match.
    marked = {b for i, r in known if r in index.prefix for b in (i // step, i // step - 1)}
    starts, out = block_starts(len(words), step), []
    for b in sorted(marked):
        if 0 <= b < len(starts):
            block = sorted({r for r in ranks[b * step : (b + 2) * step] if r >= 0})
            out += [(b * step, t, shared / len(index.templates[t][1])) for t, shared in join_block(block, index)]
    return out


def phrase_places(words: list[bytes], phrases: Sequence[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a phrase follow each other."""
    out = []
    for phrase, label in phrases:
        at = 0
        if phrase[0] in words:
            while True:
                try:
                    at = words.index(phrase[0], at)
                except ValueError:
                    break
                if tuple(words[at : at + len(phrase)]) == phrase:
                    out.append((at, label))
                at += 1
    return out


def license_index(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, step: int = STEP) -> Index:
    known = template_words(templates, step)
    return build_index(known, document_counts(docs, frozenset(w for _, own in known for w in own)), threshold)


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """Every matching block: ``doc_id``, ``first_word``, ``n_block``, ``template`` (its place in the list), ``label``, ``containment``."""
    index = license_index(docs, templates, threshold, step)
    kind = docs.schema["doc_id"].dataType

    def work(batches):
        for batch in batches:
            rows, places = [], []
            for i, text in enumerate(byte_column(batch, "text")):
                words = words_of(text)
                for start, t, containment in matches(words, index, step):
                    places.append(i)
                    rows.append((start, min(2 * step, len(words) - start), t, index.templates[t][0], containment))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *arrays],
                                             names=["doc_id", "first_word", "n_block", "template", "label", "containment"])

    schema = f"doc_id {kind.simpleString()}, first_word long, n_block long, template int, label string, containment double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """One row per document: phrase places, labels of phrases and of matched templates.

    ``score`` is 1 where a phrase stands, otherwise the highest containment of a
    template in a matching block, zero without one.
    """
    index = license_index(docs, templates, threshold, step)
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES]
    kind = docs.schema["doc_id"].dataType

    def work(batches):
        for batch in batches:
            rows = []
            for text in byte_column(batch, "text"):
                words = words_of(text)
                base = phrase_places(words, phrases)
                found = matches(words, index, step)
                own = {label for _, label in base}
                more = own | {index.templates[t][0] for _, t, _ in found}
                score = 1.0 if base else max((c for _, _, c in found), default=0.0)
                at = [p for p, _ in base]
                rows.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(more)), score))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = (f"doc_id {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)
