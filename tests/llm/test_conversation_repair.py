"""Repairs against a search over all edit sequences, damage and faults against plain code."""

import hashlib
import heapq
import re
import zlib

import numpy as np

from reviewloom.llm.common import table
from reviewloom.llm.conversation_repair import Conversation, repair_conversations, repair_damaged

ROLES = {"s": "system", "u": "user", "a": "assistant"}


def plain_repair(rows):
    """(cost, audit, repaired) by best-first search; rows: (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, written, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", written):
            return cost, audit, "\n".join(out)
        if (at, written[-1:], audit) in done:
            continue
        done.add((at, written[-1:], audit))

        def push(more, edit, step, letter="", line=None):
            after = written + letter
            if not letter or re.fullmatch("s?(ua)*u?", after):
                heapq.heappush(heap, (cost + more, audit + edit, at + step, after, out if line is None else (*out, line)))

        if at < len(rows):
            role, text, fault = rows[at]
            push(2, "D", 1)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in ROLES and role[:1]:
                    push(extra, "K", 1, role[:1], f"{role}:{text}")
                for x in "ua":
                    push(1 + extra, "R", 1, x, f"{ROLES[x]}:{text}")
        if audit.count("I") < 4:
            for x in "ua":
                push(5, "I", 0, x, f"{ROLES[x]}:")


def plain_rows(rows, damage=True):
    """Rows of one conversation (turn, role, text) after damage, in order, with faults."""
    after = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after += [(turn, role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for turn, role, text in after:
        shown = text.strip(" \t\n\v\f\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain(rows, damage=True):
    after = plain_rows(rows, damage)
    turns = [t for t, *_ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [f for *_, f in after]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
    cost, audit, repaired = plain_repair([r[1:] for r in after])
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def random_rows(rng, conv, n):
    texts = ["Yes.", "no", "So?", "", " \n", "Yes.", "what!", "a. ", None, "ü"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]
    turns = [None if rng.random() < 0.1 else int(x) for x in rng.integers(0, n + 3, n)]
    return [(conv, t, str(rng.choice(roles[:7])) if rng.random() > 0.1 else None, texts[int(rng.integers(0, 10))]) for t in turns]


def test_random_conversations_equal_search(spark):
    rng = np.random.default_rng(1)
    rows = [r for c in range(260) for r in random_rows(rng, c if c else None, int(rng.integers(1, 8)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, gone string, late int")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for damage, repair in ((True, repair_damaged), (False, repair_conversations)):
        got = {r.conv_id: tuple(r)[1:] for r in repair(df.repartition(5)).collect()}
        assert got.keys() == by.keys()
        for conv, own in by.items():
            assert got[conv] == plain(own, damage), own


def test_table_equals_search(spark):
    rows = table(spark, "/root/testdata/sf0.01", "conversations")
    by = {}
    for r in rows.collect():
        by.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    got = repair_damaged(rows)
    assert [d for _, d in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert got.keys() == by.keys()
    short = [c for c, own in by.items() if len(own) <= 8]
    assert len(short) > 30
    for conv in short:
        assert got[conv] == plain(by[conv]), conv
    assert repair_damaged(rows.limit(0)).count() == 0


def cheapest(rows):
    """Cost and audit by a table over (row, state) with whole strings."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(4):
            for q in list(best):
                for q2 in set(step[q].values()) - {1}:
                    best[q2] = min(best.get(q2, (1 << 60, "")), (best[q][0] + 5, best[q][1] + "I"))
        return best

    best = inserted(best)
    for role, _, fault in rows:
        new = {}
        for q, (cost, audit) in best.items():
            moves = [(q, 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                moves += [(q2, extra, "K") for x, q2 in step[q].items() if x == role[:1]] + [(q2, 1 + extra, "R") for x, q2 in step[q].items() if x != "s"]
            for q2, more, edit in moves:
                new[q2] = min(new.get(q2, (1 << 60, "")), (cost + more, audit + edit))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_long_conversation_is_streamed():
    rng = np.random.default_rng(7)
    talk, rows = Conversation(1), []
    for i in range(20_000):
        role = str(rng.choice(["user", "assistant", "user", "assistant", "system", "x"]))
        text = f"t{i}" + str(rng.choice([".", "", "?"]))
        rows.append((role, text, "" if text[-1] in ".?" else "truncated"))
        talk.add(i, role, text, False, False, text[-1] not in ".?")
    key, gaps, blank, duplicate, truncated, illegal, cost, audit, _ = talk.result()
    assert (cost, audit) == cheapest(rows)
    assert (gaps, blank, duplicate, truncated) == (0, 0, 0, sum(f == "truncated" for *_, f in rows))
    # Rows wait only until the survivors agree.
    assert talk.most_waiting < 100
    quiet = Conversation(2)
    for i in range(5000):
        quiet.add(i, "user", "", True, False, False)
    assert quiet.result()[6:8] == (10_000, "D" * 5000) and quiet.most_waiting < 10
