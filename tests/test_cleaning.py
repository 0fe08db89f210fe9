"""Cleaning operators against the stated cases and against Python's re and html."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import cleaning as c
from reviewloom.functions.scoring import preview


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


# Fixed cases: each pins a rule of the cleaning contract.
EXACT = [
    (c.normalize_whitespace, "too    many   spaces", "too many spaces"),
    (c.normalize_whitespace, "line one\n\nline two\t\ttabbed", "line one line two tabbed"),
    (c.normalize_whitespace, "   padded text   ", "padded text"),
    (c.normalize_whitespace, "a\u00a0b\u0085c\u001cd\u3000e", "a b c d e"),
    (c.cap_repeated_punctuation, "amazing!!!!!!!!!", "amazing!!!"),
    (c.cap_repeated_punctuation, "wait...", "wait..."),
    (c.cap_repeated_punctuation, "wow!?!?!", "wow!!!"),
    (c.cap_repeated_punctuation, "x!?. y", "x... y"),
    (c.cap_repeated_punctuation, "ok?! fine..", "ok?! fine.."),
    (c.clean_for_classical, "", ""),
    (c.clean_for_transformer, "", ""),
    (c.clean_for_classical, None, ""),
    (c.clean_for_transformer, None, ""),
    (c.clean_for_classical, "   \n\t  ", ""),
    (c.clean_for_classical, "<3 and > ok", "ok"),
    (c.clean_for_classical, "&lt;b&gt;", ""),
    (c.clean_for_classical, "&amp;quot; &#8217;x &eacute;", "&quot; ’x é"),
    (c.clean_for_classical, "a <a\nhref='x'> b", "a b"),
    (c.clean_for_classical, "This Was GREAT", "this was great"),
]


@pytest.mark.parametrize("function,text,expected", EXACT)
def test_exact_results(spark, function, text, expected):
    assert one(spark, function, text) == expected


@pytest.mark.parametrize(
    "function,text,inside,outside",
    [
        (c.clean_for_classical, "The soup was not warm.", "not warm", None),
        (c.clean_for_classical, "We never saw that band.", "never", None),
        (c.clean_for_classical, "Oddly, not expensive.", "not expensive", None),
        (c.clean_for_classical, "She couldn't hear it.", "n't", None),
        (c.clean_for_transformer, "It was not loud at all.", "not loud", None),
        (c.clean_for_transformer, "This Was GREAT", "GREAT", None),
        (c.remove_html, "Great tea.<br /><br />More of it.", "Great", "br />"),
        (c.remove_html, "Salt &amp; pepper only.", "&", "&amp;"),
        (c.remove_html, "<p>A <b>bold</b> menu</p>", "bold", "<"),
        (c.clean_for_classical, "Good bread.<br />Would return.", "would", "<br"),
        (c.clean_for_transformer, "Good bread.<br />Would return.", "Would", "<br"),
        (c.clean_for_classical, "awful!!!!!", "!", "!!!!"),
    ],
)
def test_contains(spark, function, text, inside, outside):
    got = one(spark, function, text)
    assert inside in got
    assert outside is None or outside not in got


def python_clean(text, lower):
    text = re.sub(r"<[^>]+>", " ", html.unescape(text))
    text = text.lower() if lower else text
    text = re.sub(r"([!?.]){3,}", r"\1\1\1", text)
    return re.sub(r"\s+", " ", text).strip()


def test_random_texts_equal_python(spark):
    rng = random.Random(7)
    parts = [
        "<b>", "</p\n>", "<", ">", "&amp;", "&amp;lt;", "&lt;i&gt;", "&copy", "&#39;", "&#x2014;", "&notit;",
        "&nbsp;", "&", "&&amp;", "!?", "...", "!!!!", " ", "\n\t", "\u00a0", "\u2028", "\u200b", "\u001f",
        "Word", "ÉÇ", "don't", "İ", "ΑΣ", "5", "_x", "中文", "😀", "&Eacute;", "&hellip;", "&AMP;", "&bogus;",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text_raw string")
    rows = c.add_clean_columns(df).select(
        "i", "text_clean_classical", "text_clean_transformer",
        c.word_count(F.col("text_raw")).alias("w"), c.is_blank(F.col("text_raw")).alias("b"),
        c.clean_for_classical(F.col("text_raw")).alias("again"),
    ).collect()
    for r in rows:
        text = texts[r["i"]]
        assert r["text_clean_classical"] == r["again"] == python_clean(text, True), repr(text)
        assert r["text_clean_transformer"] == python_clean(text, False), repr(text)
        assert r["w"] == len(text.split()), repr(text)
        assert r["b"] == (text.strip() == ""), repr(text)


def test_word_count_of_null(spark):
    df = spark.createDataFrame([(None,), ("a b",)], "t string")
    got = df.select(c.word_count(F.col("t")), c.word_count(F.col("t"), null_as_word=True)).collect()
    assert [tuple(r) for r in got] == [(None, 1), (2, 2)]


def test_length_limit_counts_code_points(spark):
    df = spark.createDataFrame([("😀" * 5000,), ("a" * 5001,), (None,)], "t string")
    assert [r[0] for r in df.select(c.exceeds_length(F.col("t"))).collect()] == [False, True, False]


def test_negations_survive(spark):
    texts = ["Not <b not>never</b> NO", "can't, neither&nbsp;nor; cannot", "nothing known", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = c.negation_audit(df, "t", ["i"]).orderBy("i").collect()
    assert [(r["hits_raw"], r["preserved"]) for r in rows] == [(3, True), (4, True), (0, True), (0, True)]


def test_preview(spark):
    assert one(spark, preview, "x" * 40) == "x" * 40
    assert one(spark, preview, "x" * 41) == "x" * 40 + "…"


def test_native_cleaning_has_no_python(spark):
    df = spark.range(1).select(F.lit("a").alias("t")).select(c.clean_for_classical(F.col("t"), exact=False))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_references_equal_the_standard_decoder(spark):
    """All names, with and without semicolon, numbers, and random mixtures; no Python node in the plan."""
    from html.entities import html5

    rng = random.Random(1)
    names = list(html5)
    parts = [*"&#xX;a<0 \n\f\té😀129", "&", "&#", "&#x", "amp", "lt", "&amp", "&lt;", "&notit;", "00", "128", "150", "D800", "dfff", "10FFFF", "110000", "fdd0",
             "FFFE", "feff", "65279", "1F600", "999999999", "&#x80;", "&#0;", "&#13;", "&#11;", "&&", "CounterClockwiseContourIntegral;"]
    rows = ["".join(rng.choice(parts) if rng.random() < 0.7 else "&" + rng.choice(names) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    rows += [f"&{n}{end}" for n in names for end in ("", "x", " ;")] + [f"&{n[:-1]}" for n in names]
    rows += [f"&#{i};" for i in range(0x300)] + [f"&#x{i:x}" for i in (*range(0xD7F0, 0xE010, 7), *range(0xFDC0, 0xFE00), 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000)]
    rows += ["", "&", "&" + "a" * 40 + ";", "&" + "😀" * 33 + ";"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").repartition(4).select("i", c.html_unescape(F.col("t")).alias("u"))
    got = {r.i: r.u for r in df.collect()}
    assert [r for i, r in enumerate(rows) if got[i] != html.unescape(r)] == []
    assert one(spark, c.html_unescape, None) is None
    plan = spark.range(1).select(c.clean_for_classical(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "ArrowEval" not in plan
