"""Text cleaning as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII only, so the Unicode whitespace class is spelled out.
SPACE_CLASS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
# Word characters in the Unicode sense; the ASCII ranges are there for speed.
WORD_CLASS = r"a-z0-9_\p{L}\p{N}"

# HTML references decoded natively. The ampersand comes last, so
# the chain of replacements equals one left-to-right pass.
COMMON_REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#x27;": "'",
    "&#34;": '"',
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&hellip;": "…",
    "&mdash;": "—",
    "&ndash;": "–",
    "&amp;": "&",
}

# Words whose loss would flip the meaning of a review.
NEGATION_WORDS = ("not", "never", "no", "n't", "cannot", "neither", "nor")


# Fixed pattern: what can be a reference, behind its ampersand.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0c <&#;]{1,32};?)"
_HIGHEST = 0x10FFFF


def _map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _replaced_codes() -> dict[int, str]:
    """Numbers that stand for another character: null, carriage return, and the old code page 1252 in the control range."""
    page = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    return {0: "\ufffd", 0x0D: "\r"} | page


def _character(code: Column) -> Column:
    """The character of a numeric reference; null for a number beyond Unicode."""
    # A byte order mark in front, so that one that is meant is kept.
    plain = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
    below = code % 0x10000
    dropped = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (below >= 0xFFFE)
    return (
        F.when(code.isin(*_replaced_codes()), F.element_at(_map_of(_replaced_codes()), code))
        .when(code.between(0xD800, 0xDFFF) | (code > _HIGHEST), "\ufffd")
        .when(dropped, "")
        .otherwise(plain)
    )


@cache
def _names() -> tuple[str, str]:
    """All names of the standard by first letter, as JSON, and a pattern of those that need no semicolon, longest first."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in sorted(html5.items()):
        by_letter.setdefault(name[0], {})[name] = text
    short = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(by_letter), "^(" + "|".join(short) + ")"


def _decoded_piece(piece: Column) -> Column:
    """What an ampersand and the text behind it, up to the next one, stand for."""
    by_letter, short = _names()
    found = F.regexp_extract(piece, _REFERENCE, 1)
    rest = F.substring(piece, F.length(found) + 1, F.length(piece))
    hexadecimal = found.rlike("^#[xX]")
    digits = F.regexp_extract(found, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    padded = F.concat(F.lit("0"), digits)
    # More digits than the highest number has are beyond it, whatever they are.
    code = (
        F.when(F.length(digits) > 7, _HIGHEST + 1)
        .when(hexadecimal, F.conv(padded, 16, 10).cast("int"))
        .otherwise(F.regexp_extract(padded, "^[0-9]+", 0).cast("int"))
    )

    # A constant, folded once; two short searches instead of a long one.
    table = F.from_json(F.lit(by_letter), "map<string,map<string,string>>")

    def named(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)

    prefix = F.regexp_extract(found, short, 1)
    by_prefix = F.when(prefix != "", F.concat(named(prefix), F.substring(found, F.length(prefix) + 1, F.length(found))))
    text = F.coalesce(named(found), by_prefix, F.concat(F.lit("&"), found))
    return F.concat(
        F.when(found == "", "&").when(found.startswith("#"), _character(code)).otherwise(text), rest
    )


def html_unescape(text: Column, exact: bool = True) -> Column:
    """Decode HTML references in one pass, as the standard has them.

    Rows with nothing but ``COMMON_REFERENCES`` go through plain replacements. In all others the
    text is split at its ampersands, and every piece looks up the longest reference it begins
    with: a number, a name, or the front of a longer word that is a name without
    semicolon. ``exact=False`` leaves that part out, for corpora known to use nothing else.
    """
    decoded = text
    for reference, char in COMMON_REFERENCES.items():
        decoded = F.replace(decoded, F.lit(reference), F.lit(char))
    if not exact:
        return decoded
    names = "|".join(r[1:-1] for r in COMMON_REFERENCES)
    uncommon = text.contains("&") & text.rlike(f"&(?!(?:{names});)[^\\t\\n\\x0c <&;]")
    pieces = F.split(text, "&")
    behind = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _decoded_piece)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(behind, ""))
    return F.when(uncommon, whole).otherwise(decoded)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def remove_html(text: Column, exact: bool = True) -> Column:
    # Most texts hold neither tags nor references; a byte search finds out.
    marked = text.contains("<") | text.contains("&")
    return F.when(marked, strip_tags(html_unescape(text, exact))).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def cap_repeated_punctuation(text: Column) -> Column:
    """Runs of three or more of ``!?.`` become three copies of the last one."""
    # Fixed pattern: which marks count, and how many of them.
    return F.regexp_replace(text, "([!?.]){3,}", "$1$1$1")


def _finish(without_html: Column) -> Column:
    tidy = normalize_whitespace(cap_repeated_punctuation(without_html))
    return F.coalesce(tidy, F.lit(""))


def clean_for_classical(text: Column, exact: bool = True) -> Column:
    """Lower-cased form for bag-of-words features; null becomes ``""``."""
    return _finish(F.lower(remove_html(text, exact)))


def clean_for_transformer(text: Column, exact: bool = True) -> Column:
    """Case-keeping form; null becomes ``""``."""
    return _finish(remove_html(text, exact))


def add_clean_columns(df, text_col: str = "text_raw", exact: bool = True):
    """Both cleaned forms from one shared HTML-free intermediate."""
    bare = "__without_html"
    return (
        df.withColumn(bare, remove_html(F.col(text_col), exact))
        .withColumn("text_clean_classical", _finish(F.lower(F.col(bare))))
        .withColumn("text_clean_transformer", _finish(F.col(bare)))
        .drop(bare)
    )


def word_count(text: Column, null_as_word: bool = False) -> Column:
    """Whitespace-separated words of the raw text.

    ``null_as_word`` counts a null as one word, as happens when a table of
    strings is cast before counting.
    """
    n = F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))
    return F.coalesce(n, F.lit(1)) if null_as_word else n


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(f"[^{SPACE_CLASS}]"), F.lit(False))


def exceeds_length(text: Column, limit: int = 5000) -> Column:
    return F.coalesce(F.length(text) > F.lit(limit), F.lit(False))


def negation_hits(text: Column) -> Column:
    """Occurrences of the negation words: whole words, and the suffix n't."""
    lowered = F.lower(text)
    whole = [w for w in NEGATION_WORDS if w != "n't"]
    words = F.regexp_extract_all(lowered, F.lit(f"[{WORD_CLASS}]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*whole))) + F.regexp_count(
        lowered, F.lit("n't")
    )


def negation_audit(df, text_col: str, id_cols: list[str], clean=clean_for_classical):
    """Negation words per row before and after cleaning; they must be equal.

    Words inside tags are not text, so the first count is taken after the HTML
    is gone.
    """
    return df.select(
        *id_cols,
        negation_hits(F.coalesce(remove_html(F.col(text_col)), F.lit(""))).alias("hits_raw"),
        negation_hits(clean(F.col(text_col))).alias("hits_clean"),
    ).withColumn("preserved", F.col("hits_raw") == F.col("hits_clean"))
