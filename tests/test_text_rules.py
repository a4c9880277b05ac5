"""Text rules on hand-made cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions import values as v
from clausemill.functions.python import absolute_url, display_pair
from clausemill.operators import extract


def apply(spark, function, values):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x string")
    return [r.y for r in df.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()]


def test_headings(spark):
    cases = {
        "PART II: Scope": ("part", "II", "Scope", None), "Chapter 3": ("part", "3", None, None), "1. Title": ("section", "1", "Title", None),
        "1.1 Title": ("subsection", "1.1", "Title", None), "1.1.2. Title": ("subsection", "1.1.2", "Title", None), "(a) text": ("clause", "(a)", None, "text"),
        "1) text": ("clause", "1)", None, "text"), "Table 4: x": ("table", "4", "x", None), "Table limits": ("table", "limi", "ts", None),
        "Annex details": ("annex", "d", "etails", None), "Schedule II - x": ("annex", "II", "x", None), "Note: x": ("footnote", None, None, "x"),
        "N.B. x": ("footnote", None, None, "x"), "2018 was a year": ("section", "2018", "was a year", None),
    }
    got = apply(spark, tx.classify_heading, list(cases))
    assert [tuple(x) for x in got] == list(cases.values())
    assert apply(spark, tx.classify_heading, ["Section 11(1) of", "PART", "ALL CAPS TITLE", ""]) == [None] * 4
    lines = ["Annexure B", "Section 11(1) of", "partial", "3.2 x", "3", "ALL CAPS TITLE", "CAPS", "  4. indented ", "1. " + "x" * 98, "1. " + "x" * 97, "", None]
    assert apply(spark, tx.is_heading, lines) == [True, True, False, True, False, True, False, True, False, True, False, False]


def test_clean_tokens(spark):
    cases = {"(a)": True, "(b)": False, "5A": False, "1st": True, "161/2018": True, "25%": True, "a..b": False, "~1..i": False, "RBI": True, "BCDFGH": False, "rhythm": True, "brrr": False, "–": False, "": False, "x�y": False, "don't": True, "1/2/3/4": False, "I": True, "x=1": False, "Übung": True, "юля": False}
    assert dict(zip(cases, apply(spark, tx.is_clean_token, list(cases)), strict=True)) == cases


def test_plain_tokens_are_clean(spark):
    """What passes without a judgement would be judged clean, and lines are judged whole where nothing passes."""
    rnd = random.Random(3)
    tokens = ["".join(rnd.choice("aeiouyAEbcdXRÜß0123.,;:!?()[]{}'\"/-–—%~=") for _ in range(rnd.randint(1, 6))) for _ in range(4000)] + ["naïve", "12.", "word.,", "word..", "e", "ab"]
    clean = apply(spark, tx.is_clean_token, tokens)
    plain = apply(spark, tx.has_plain_token, tokens)
    assert all(c for c, p in zip(clean, plain, strict=True) if p) and 200 < sum(plain) < sum(clean)
    assert apply(spark, tx.has_other_token, tokens) == [not p for p in plain]
    lines = [" ".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 5))) for _ in range(500)]
    known = dict(zip(tokens, clean, strict=True))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line_no int, raw string")
    left = {k: " ".join(t for t in x.split() if known[t]) for k, x in enumerate(lines) if not x.split() or any(known[t] for t in x.split())}
    assert {r.line_no: r.raw for r in extract.denoise_lines(df).collect()} == left
    assert extract.denoise_stats(df, []).first().lines_dropped == len(lines) - len(left)


def test_words(spark):
    assert apply(spark, tx.tokens, ["The Bank's 3 rules, and a 42"]) == [["bank", "rules", "42"]]
    assert apply(spark, tx.concept_tokens, ["Monitoring of Straßen provisions", None]) == [["monitor", "of", "strassen", "provision"], None]
    stems = {"monitoring": "monitor", "policies": "policy", "ties": "ties", "notifications": "notific", "ings": "ings", "boxes": "box", "statements": "state", "classes": "class"}
    assert dict(zip(stems, apply(spark, tx.stem, list(stems)), strict=True)) == stems
    assert apply(spark, tx.tight, ["  A  B  ", "X.", None, "Maß"]) == ["a b", "x.", "", "mass"]
    assert apply(spark, tx.loose, ["  A  B. ;' ", "...", None, "a b.;'"]) == ["a b.", "", "", "a b"]


def test_clause_numbers(spark):
    cases = {"4": True, "4.2": True, "4.5.5": True, "99": True, "100": False, "1934": False, "007": True, "1.": False, "(a)": False, "": False, None: False}
    assert dict(zip(cases, apply(spark, tx.is_clause_number, list(cases)), strict=True)) == cases


def test_payload_tail(spark):
    cases = {'pre {"a":1}': '{"a":1}', "none": None, "{bad": None, '{"a":1} tail': None, '[1] {"a":{}}  ': '{"a":{}}'}
    assert dict(zip(cases, apply(spark, tx.json_tail, list(cases)), strict=True)) == cases
    assert apply(spark, tx.json_array, ["x [1, [2]] y", "none"]) == ["[1, [2]]", None]


def test_citations(spark):
    got = apply(spark, tx.citations, ["see [DOC 4.2] and [6, 7] [1][2] [DOC X]"])[0]
    assert [tuple(x) for x in got] == [("DOC", "4.2"), ("6,", "7")]


def test_latin1(spark):
    assert apply(spark, tx.latin1, ["“a”–b… ₹5 • ☃\xa0é", None]) == ['"a"-b... Rs.5 - ? é', ""]


def test_numbers(spark):
    assert apply(spark, v.confidence, ["x", "1.7", "-1", None, "0.25", "nan"]) == [None, 1.0, 0.0, None, 0.25, None]
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r.d for r in df.select(v.dot(F.col("a"), F.col("b")).alias("d")).collect()] == [14.0, 0.0]
    unit = df.select(v.unit_array(F.col("b")).alias("u")).first().u
    assert sum(x * x for x in unit) == pytest.approx(1)


def test_python_functions(spark):
    df = spark.createDataFrame([("http://h/a/b", "../c"), ("http://h/", None)], "base string, link string")
    assert [r.u for r in df.select(absolute_url("base", "link").alias("u")).collect()] == ["http://h/c", None]
    pairs = spark.createDataFrame([("same text here", "same text here."), ("one", "another thing"), ("", "only"), ("only", None)], "a string, b string")
    got = [tuple(r.p) for r in pairs.select(display_pair(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [("same text here", None), ("one", "another thing"), ("only", None), ("only", None)]
