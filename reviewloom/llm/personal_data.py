"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The patterns (e-mail, IP address, card, phone) always count. The random field scores
whole candidate segments of a short stretch of text (a run of digits and separators,
or the surroundings of an @ or its spelled form) by features of the whole
segment, and dynamic programming over segments of bounded length chooses boundaries and
types together; anything it finds beside the pattern spans is added. It is trained
here on stretches of a bounded sample of documents, whose pattern spans are the truth,
and on copies of them in which the spans are respelled (user at host dot org, numbers
without a plus sign, 1[.]2[.]3[.]4).

Rows: null texts count as empty, an empty text has no span (hash of the empty string);
every row is judged by itself, repeated ids included; extra columns are ignored, or
kept by ``mask``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and the patterns behind them.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Stretches in which a segment may lie.
NUMERIC = re.compile(r"[+(]?[0-9](?:[().\[\]\x20_+-]{0,3}[0-9])+")
SPELLED = re.compile(r"@|[\[(]at[\])]|\bat\b(?=[^\n]{1,60}\bdot\b)", re.I)
AROUND = 64
PIECE = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
MOST_PIECES, MOST_LENGTH = 24, 80
DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards (no rescans of long words)."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        hit = DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            out.append((start, hit.end()))
            free = hit.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind by the fixed patterns, leftmost, not overlapping within a kind."""
    ips = []
    for chain in CHAIN.finditer(text):
        # A chain of numbers is taken four at a time.
        bounds = [(m.start() + chain.start(), m.end() + chain.start()) for m in re.finditer("[0-9]+", chain.group())]
        for i in range(0, len(bounds) - 3, 4):
            if all(small_part(text[a:b]) for a, b in bounds[i : i + 4]):
                ips.append((bounds[i][0], bounds[i + 3][1]))
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in DIGITS for c in m.group()) <= 15]
    return [email_spans(text), ips, cards, phones]


# ---- random field -------------------------------------------------------------

GROUPS = 60  # features of a segment; every kind has its own weights
SIZE = GROUPS * len(KINDS)


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged stretches that can hold a segment."""
    found = [m.span() for m in NUMERIC.finditer(text) if m.end() - m.start() >= 7]
    if "@" in text or " dot " in text.lower() or "at]" in text or "at)" in text:
        found += [(max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)) for m in SPELLED.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kind_of_char(text: str, i: int) -> int:
    if not 0 <= i < len(text):
        return 0
    c = text[i]
    return 1 if c.isspace() else 2 if c in DIGITS else 3 if c.isalpha() else 4 if c in "+-_" else 5 if c in ".," else 6


def segment_features(text: str, a: int, b: int, kind: int) -> list[int] | None:
    """Indices of the features of a whole segment, None where the kind rules the segment out."""
    own = text[a:b]
    n = sum(c in DIGITS for c in own)
    on = [0, 1 + kind_of_char(text, a - 1), 8 + kind_of_char(text, b)]
    if kind == 0:
        low = own.lower()
        signs = low.count("@") + low.count(" at ") + low.count("[at]") + low.count("(at)")
        if signs != 1 or "\n" in own or own[0] in " .@" or not own[-1].isalnum():
            return None
        left, right = re.split(r"@|\s?[\[(]at[\])]\s?| at ", low, maxsplit=1)
        if not left or not right or " " in left:
            return None
        parts = re.split(r"\.|\s?[\[(]dot[\])]\s?| dot ", right)
        plain = all(re.fullmatch("[a-z0-9-]+", p) for p in parts)
        on += [15 + min(len(parts), 5), 21 + plain, 23 + ("@" in low), 25 + all(c in LOCAL for c in left)]
        on += [27 + (2 <= len(parts[-1]) <= 6 and parts[-1].isalpha()), 29 + min(len(own) // 16, 4), 58 + (" dot " in low)]
        return on
    if own[-1] not in DIGITS or own[0] not in DIGITS and own[0] not in "+(":
        return None
    parts = re.findall("[0-9]+", own)
    if kind == 1:
        if len(parts) != 4 or own[0] not in DIGITS or re.search(r"[^0-9.\[\]]", own):
            return None
        return on + [15 + all(map(small_part, parts)), 17 + (own.count(".") == 3), 19 + ("[.]" in own)]
    if kind == 2:
        if not 12 <= n <= 19 or own[0] not in DIGITS or re.search(r"[^0-9 ._-]", own):
            return None
        sizes = {len(p) for p in parts[:-1]}
        return on + [15 + luhn("".join(parts)), 17 + min(n - 12, 8), 26 + min(len(parts) - 1, 4), 31 + (sizes <= {4}), 33 + ("." in own)]
    if not 7 <= n <= 15 or "[" in own or "_" in own or own.count("+") > (own[0] == "+"):
        return None
    return on + [15 + n - 7, 24 + (own[0] == "+"), 26 + ("(" in own), 28 + min(len(parts) - 1, 5), 34 + ("-" in own),
                 36 + (own[:2] == "00"), 38 + (own.count("(") == own.count(")")), 40 + (own.count(".") == len(parts) - 1 and len(parts) > 1)]


def segments(text: str, a: int, b: int) -> tuple[list[int], list[list[tuple[int, int, np.ndarray]]]]:
    """Piece boundaries of a stretch, and for each end piece its (first piece, kind, features)."""
    bounds = [m.start() for m in PIECE.finditer(text, a, b)]
    bounds.append(b)
    n = len(bounds) - 1
    ends: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in range(n + 1)]
    window = text[a:b]
    sign: set[int] = set()
    for m in SPELLED.finditer(window):
        # The pieces that a sign touches, from the one it begins in.
        i = bisect_right(bounds, a + m.start()) - 1
        while i < n and bounds[i] < a + m.end():
            sign.add(i)
            i += 1
    for i in range(n):
        c = text[bounds[i]]
        numeric = c in DIGITS or c in "+("
        mail = bool(sign) and (c.isalnum() and c.isascii())
        if not numeric and not mail or i and c in DIGITS and text[bounds[i] - 1] in DIGITS:
            continue
        signed = False
        for j in range(i, min(n, i + MOST_PIECES)):
            last = text[bounds[j]]
            if bounds[j + 1] - bounds[i] > MOST_LENGTH:
                break
            signed = signed or j in sign
            numeric = numeric and (last in DIGITS or last in "()[]. _+-")
            if not numeric and not mail:
                break
            for kind in range(4):
                if (mail and signed) if kind == 0 else numeric:
                    features = segment_features(text, bounds[i], bounds[j + 1], kind)
                    if features is not None:
                        ends[j + 1].append((i, kind, np.array(features) + kind * GROUPS))
    return bounds, ends


def best_path(text: str, a: int, b: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Segments (kind, start, end) of the best segmentation; a piece outside segments scores zero."""
    bounds, ends = segments(text, a, b)
    best, back = [0.0] * len(bounds), [None] * len(bounds)
    for e in range(1, len(bounds)):
        best[e] = best[e - 1]
        for i, kind, features in ends[e]:
            score = best[i] + float(weights[features].sum())
            if score > best[e] + 1e-12:
                best[e], back[e] = score, (i, kind)
    out, e = [], len(bounds) - 1
    while e > 0:
        if back[e]:
            out.append((back[e][1], bounds[back[e][0]], bounds[e]))
            e = back[e][0]
        else:
            e -= 1
    return out[::-1]


def fit_field(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 6, rate: float = 0.3, penalty: float = 1e-4) -> np.ndarray:
    """Weights by stochastic gradient (AdaGrad) on the likelihood of the true segmentations."""
    weights, squares = np.zeros(SIZE), np.full(SIZE, 1e-6)
    weights[::GROUPS] = -2.0
    prepared = []
    for text, truth in examples:
        for a, b in stretches(text):
            bounds, ends = segments(text, a, b)
            place = {x: i for i, x in enumerate(bounds)}
            gold = {(place[s], place[e], k) for k, s, e in truth if s in place and e in place}
            if any(ends):
                prepared.append((len(bounds), [(i, e, k, f, (i, e, k) in gold) for e, row in enumerate(ends) for i, k, f in row]))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for x in rng.permutation(len(prepared)):
            n, rows = prepared[x]
            score = [float(weights[f].sum()) for _, _, _, f, _ in rows]
            into: list[list[int]] = [[] for _ in range(n)]
            out_of: list[list[int]] = [[] for _ in range(n)]
            for r, (i, e, *_) in enumerate(rows):
                into[e].append(r), out_of[i].append(r)
            forward, backward = np.zeros(n), np.zeros(n)
            for e in range(1, n):
                terms = [forward[e - 1], *[forward[rows[r][0]] + score[r] for r in into[e]]]
                forward[e] = np.logaddexp.reduce(terms) if len(terms) > 1 else terms[0]
            for i in range(n - 2, -1, -1):
                terms = [backward[i + 1], *[backward[rows[r][1]] + score[r] for r in out_of[i]]]
                backward[i] = np.logaddexp.reduce(terms) if len(terms) > 1 else terms[0]
            gradient: dict[int, float] = {}
            for r, (i, e, _, features, true) in enumerate(rows):
                change = true - float(np.exp(min(0.0, forward[i] + score[r] + backward[e] - forward[n - 1])))
                if abs(change) > 1e-5:
                    for f in features.tolist():
                        gradient[f] = gradient.get(f, 0.0) + change
            for f, g in gradient.items():
                g -= penalty * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / np.sqrt(squares[f])
    return weights


def respelled(text: str, truth: list[tuple[int, int, int]], turn: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans spelled otherwise, and where they are now."""
    out, spans, at = "", [], 0
    for kind, a, b in truth:
        own = text[a:b]
        if kind == 0:
            sign, dot = ((" at ", " dot "), ("[at]", "."), (" (at) ", " dot "), ("@", " dot "))[turn % 4]
            local, domain = own.split("@", 1)
            new = local.replace(".", "_") + sign + domain.replace(".", dot)
        elif kind == 1:
            new = own.replace(".", "[.]")
        elif kind == 2:
            digits = own.replace(" ", "").replace("-", "")
            new = "-._ "[turn % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            new = (own.replace("+", "00", 1), own[own.find("(") :] if "(" in own else own)[turn % 2]
        out += text[at:a]
        spans.append((kind, len(out), len(out) + len(new)))
        out, at = out + new, b
    return out + text[at:], spans


def apart(spans: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of start, the longest of overlapping ones."""
    out: list[tuple[int, int, int]] = []
    for kind, a, b in sorted(((k, a, b) for k, own in enumerate(spans) for a, b in own), key=lambda s: (s[1] - s[2], s)):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: s[1])


def train(docs: DataFrame, sample_docs: int = 3_000, examples: int = 1_500, per_text: int = 8, longest: int = 200) -> np.ndarray:
    """Fit on stretches of about ``sample_docs`` documents, chosen by a hash of id and text.

    The bounds of the training sample: the first ``per_text`` stretches of a text, the first ``longest``
    characters of each, and ``examples`` of these in the order of a hash. Spans are looked for in whole texts.
    """
    total = docs.count()
    part = int(1_000_000 * min(1.0, sample_docs / max(1, total)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < part).where("text rlike '[0-9@]'")

    def work(batches):
        for batch in batches:
            cut = []
            for text in batch.column(0).to_pylist():
                for a, b in stretches(text)[:per_text]:
                    cut.append(text[max(0, a - 60) : min(b, a + longest) + 60])
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], names=["text"])

    rows = chosen.select("text").mapInArrow(work, "text string").distinct().toPandas()["text"].tolist()
    rows.sort(key=lambda t: hashlib.md5(t.encode()).digest())
    held = []
    for turn, text in enumerate(rows[:examples]):
        truth = apart(base_spans(text))
        held.append((text, truth))
        if truth:
            held.append(respelled(text, truth, turn))
    return fit_field(held)


def all_spans(text: str, weights: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Pattern spans, and pattern spans plus those the random field adds, by kind."""
    base = base_spans(text)
    # What the patterns cover, as rising intervals apart from each other.
    starts: list[int] = []
    ends: list[int] = []
    for x, y in sorted(s for own in base for s in own):
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x), ends.append(y)
    whole = [list(own) for own in base]
    for a, b in stretches(text):
        for kind, x, y in best_path(text, a, b, weights):
            i = bisect_right(ends, x)
            if i == len(starts) or y <= starts[i]:
                whole[kind].append((x, y))
    return base, [sorted(own) for own in whole]


def spelled(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, own in enumerate(spans) for a, b in own)


def find_personal_data(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id``, counts of the pattern spans by kind, ``base_sha256`` of them, ``spans`` (all)."""

    def work(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                base, whole = all_spans(text or "", weights)
                for own, found in zip(counts, base, strict=True):
                    own.append(len(found))
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(whole))
            arrays = [ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def masked(text: str, weights: np.ndarray) -> str:
    out, at = [], 0
    for kind, a, b in sorted(((k, a, b) for k, own in enumerate(all_spans(text, weights)[1]) for a, b in own), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, if there, follows the text."""
    columns = docs.columns

    def work(batches):
        for batch in batches:
            i = columns.index("text")
            texts = [t if t is None else masked(t, weights) for t in batch.column(i).to_pylist()]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            if "n_chars" in columns:
                k = columns.index("n_chars")
                length = pa.array([old if t is None else len(t) for t, old in zip(texts, batch.column(k).to_pylist(), strict=True)], batch.schema.field(k).type)
                batch = batch.set_column(k, batch.schema.field(k), length)
            yield batch

    return docs.mapInArrow(work, docs.schema)
