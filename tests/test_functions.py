"""Scalar functions and similarities against vectors worked out by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions import html, norm


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_normalize_order_matters():
    assert norm.normalize("Chiò") == "chio"
    assert norm.normalize("Alzheimer’s – ﬁne") == "alzheimer's - fine"
    assert norm.normalize("neuro-\ndegenerative") == "neurodegenerative"
    assert norm.normalize(" a  b­\n c ") == "a b c"
    assert norm.normalize(None) == "" and norm.normalize("") == ""
    assert norm.normalize("Ø ø") == "ø o"  # only the small letter is in the table


def test_tokens():
    assert norm.tokens("Well-known 'x' Alzheimer’s") == ["well-known", "x", "alzheimer's"]
    assert norm.tokens(None) == []


def test_phonetic_meets_misspelling():
    assert norm.phonetic_key("riluzole") == norm.phonetic_key("rilusole")
    assert norm.phonetic_key("ab") == "" and norm.phonetic_key("12345") == ""
    assert norm.metaphone("physics") == "FSKS" and norm.metaphone("knee") == "N" and norm.metaphone("wright") == "RT"


def test_similarities():
    assert norm.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert norm.jaro_winkler("", "a") == 0.0 and norm.jaro_winkler("a", "a") == 1.0
    assert norm.title_similarity("A <i>new</i> drug", "drug a new") == 1.0
    assert norm.title_similarity("", "x") == 0.0
    assert norm.partial_ratio("abcd", "xxabcdyy") == 1.0
    assert 0.7 < norm.partial_ratio("abcd", "xxabxdyy") < 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence_is_the_plain_one(a, b):
    assert norm._common(a, b) == lcs(a, b)


def test_snippet():
    text = "x" * 200 + " Motor neuropathy is rare"
    s = norm.snippet(text, ["neuropathy", "motor"])
    assert "[Motor] [neuropathy]" in s and s.startswith("…")
    assert norm.snippet("short", ["absent"]) == "short"
    assert norm.snippet("Chiò says", ["chio"]) == "[Chiò] says"


def test_html():
    raw = "<html><title>A &amp; B</title><body><p>One<script>x</script></p><div>Two</div></body></html>"
    assert html.html_text(raw) == "A & B\nOne\nTwo\n"
    assert html.html_text(None) == "\n"


def test_column_functions(spark):
    assert one(spark, "# Title here\nbody", C.title_guess) == "Title here"
    assert one(spark, "| a\n- b\nxyz", C.title_guess) is None
    assert one(spark, None, C.title_guess) is None
    assert one(spark, "a/b/my paper?.pdf", C.safe_stem) == "my paper"
    assert one(spark, "???", C.safe_stem) == "document"
    assert one(spark, "10.1000/XYZ.Received", C.normalize_doi) == "10.1000/xyz"
    assert one(spark, "https://doi.org/10.1000/ab)c", C.normalize_doi) == "10.1000/ab"
    assert one(spark, "978-0-306-40615-7", C.isbn_valid) == "9780306406157"
    assert one(spark, "080442957X", C.isbn_valid) == "080442957X"
    assert one(spark, "9780306406158", C.isbn_valid) is None
    assert one(spark, "���ab", C.garbage_ratio) == pytest.approx(0.6)
    assert one(spark, None, C.garbage_ratio) == 0.0
    assert one(spark, 'Sure:\n```json\n{"a": 1}\n```', C.json_reply) == '{"a": 1}'
    assert one(spark, "no object", C.json_reply) is None
    assert one(spark, "a, B;b\n a ,", C.clean_tags) == ["a", "B"]
    assert one(spark, "p. 12 — of 20", C.line_template) == "p # of #"
    assert one(spark, None, C.approx_tokens) == 1
    assert one(spark, "seen 2019-03", C.first_year) == 2019


def test_stage_percent(spark):
    rows = spark.createDataFrame([("ocr", 1.0, 2.0), ("other", 0.0, 0.0), ("publish", 5.0, 5.0)], "s string, d double, t double")
    got = [r.p for r in rows.select(C.stage_percent(F.col("s"), F.col("d"), F.col("t")).alias("p")).collect()]
    assert got == [25.0, 99.0, 99.0]


def test_partial_ratio_from_agrees():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        p = norm.partial_ratio(a, b)
        assert norm.partial_ratio_from(a, b, 0.6) == (p if p > 0.6 else 0.0)


def test_partial_ratio_from_leaves_no_window_out():
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choices("abcdefgh ", k=rng.randint(1, 30)))
        b = "".join(c if rng.random() > 0.12 else rng.choice(["", "x", c + "a"]) for c in "".join(rng.choices("abcdefgh ", k=rng.randint(0, 20))) + a[rng.randint(0, 3) :] + "tail of it"[: rng.randint(0, 10)])
        p = norm.partial_ratio(a, b)
        for least in (0.5, 0.79, 0.85, 0.95):
            assert norm.partial_ratio_from(a, b, least) == (p if p > least else 0.0), (a, b, least)
