"""Problem 5 on pages with planted faults, problem 9 on held-out marks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import levels, scans

CLEAN = "The primary outcome was the change in respiratory capacity from enrolment until the following week. Previous studies have reported conflicting effects on quality of life, possibly owing to small sample sizes. We recorded no significant interaction between genotype and dosage in patients with motor neuropathy. Statistical analysis was based on logistic regression and missing values were imputed. A well-known double-blind survey measured the long-lived response of participants."


FAULTS = [("capacity", "copacity"), ("neuropathy", "neuropafhy"), ("from", "frorn"), ("regression", "regressi on"), ("quality", "qua1ity"), ("outcome", "outcorne"), ("small", "sma~ll"), ("logistic", "logisfic"), ("conflicting", "conf1icting"), ("effects", "effecfs"), ("based", "bascd"), ("missing", "rnissing")]


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(8)
    words = CLEAN.split()
    docs = [(i, "text", f"Clean {i}", " ".join(rng.sample(words, len(words)) + words * 2)) for i in range(300)]
    chunks, want = [], set()
    for d in range(100, 112):
        pages = []
        for p in (1, 2, 3):
            body = (words * 2)[rng.randrange(40) :][:70]
            lines, at = [], 0
            while at < len(body):
                lines.append(" ".join(body[at : at + 8]))
                at += 8
            rows = [f"Notes on neuropathy   {p}", *lines, f"— {p + 10} —"]
            want |= {(d, p, 0, "furniture"), (d, p, len(rows) - 1, "furniture")}
            for i in range(1, len(rows) - 1):
                good, bad = FAULTS[(d + p + i) % len(FAULTS)]
                if good in rows[i].split()[:-1]:
                    rows[i] = rows[i].replace(good, bad, 1)
                    want.add((d, p, i, "misread"))
            for i in range(2, len(rows) - 2):
                nxt = rows[i + 1].split()
                if i % 4 == 3 and len(nxt[0]) > 7 and nxt[0].isalpha() and nxt[0] in words:
                    rows[i] += " " + nxt[0][:4] + "-"
                    rows[i + 1] = " ".join([nxt[0][4:], *nxt[1:]])
                    want.add((d, p, i, "hyphen"))
            pages.append("\n".join(rows))
            chunks.append((d, p - 1, p, "\n".join(rows)))
        docs.append((d, "scan", "Notes on neuropathy", "\f".join(pages)))
    return spark.createDataFrame(docs, "doc_id bigint, kind string, title string, text string"), spark.createDataFrame(chunks, "doc_id bigint, idx int, page int, text string"), want


OCR = "ocr_id bigint, doc_id bigint, page int, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"


def test_planted_faults(spark, scanned):
    docs, chunks, want = scanned
    dirt = spark.createDataFrame([(1, 100, 1, None), (2, 100, 2, []), (3, None, 1, [("x", 0.0, 0.0, 1.0, 1.0, 0.5)]), (4, 0, 1, [("106", 0.0, 0.0, 1.0, 1.0, 0.5)])], OCR)
    more = spark.createDataFrame([(100, 9, 9, None), (None, 0, 1, "x"), (0, 0, 1, "12")], "doc_id bigint, idx int, page int, text string")
    c = chunks.unionByName(chunks).unionByName(more).withColumn("title", F.lit("clash")).withColumn("tbl", F.lit("clash"))
    rows = scans.read_pages(c, dirt, docs.withColumn("lines", F.lit("clash")).withColumn("page", F.lit(1))).collect()
    got = {(r.doc_id, r.page, m.line_no, m.kind) for r in rows for m in r.marks}
    assert len(rows) == 36 and {r.tbl for r in rows} == {"chunks"}
    for kind in ("furniture", "hyphen", "misread"):
        w, g = {x for x in want if x[3] == kind}, {x for x in got if x[3] == kind}
        assert w and len(w & g) / len(w) >= 0.95 and len(w & g) / len(g) >= 0.9, kind
    text = next(r.text for r in rows if r.page == 2)
    assert "copacity" not in text and "neuropafhy" not in text and "—" not in text and "- " not in text


def test_marks_do_not_depend_on_the_size_of_the_corpus(spark, scanned, monkeypatch):
    docs, chunks, _ = scanned
    plain = spark.createDataFrame([(1000 + i, "text", None, "from " * 40 + ("frorn " if i % 2 else "")) for i in range(500)], docs.schema)
    docs = docs.unionByName(plain)
    monkeypatch.setattr(scans, "CORPUS", 60_000, raising=False)  # the tables hold more

    def marks(d, c):
        return {(r.doc_id, r.page, m.line_no, m.kind) for r in scans.read_pages(c, spark.createDataFrame([], OCR), d).collect() if r.doc_id < 10_000 for m in r.marks}

    def twice(t):
        return t.unionByName(t.withColumn("doc_id", F.col("doc_id") + 10_000))

    once = marks(docs, chunks)
    wrong = {(r.doc_id, r.page, i, "misread") for r in chunks.collect() for i, line in enumerate(r.text.split("\n")) if "frorn" in line}
    assert wrong and wrong <= once and marks(twice(docs), twice(chunks)) == once


def test_rare_words_are_counted_exactly(spark, scanned, monkeypatch):
    docs, chunks, _ = scanned
    rare = spark.createDataFrame([(1000, "text", None, "lagophthalmos " * 3), (200, "scan", None, "of lago-\nphthalmos and ZE LKIE26"), (1001, "text", None, "ZELKIE26 " * 3)], docs.schema)
    pages = spark.createDataFrame([(200, 0, 1, "The outcome of mild lago-\nphthalmos and ZE LKIE26 was small")], chunks.schema)
    for name, value in {"CORPUS": 4_000, "WORDS": 60}.items():  # all of these are beyond the words broadcast
        monkeypatch.setattr(scans, name, value, raising=False)
    rows = scans.read_pages(chunks.unionByName(pages), spark.createDataFrame([], OCR), docs.unionByName(rare)).where("doc_id = 200").collect()
    assert {(m.line_no, m.kind) for r in rows for m in r.marks} == {(0, "hyphen"), (1, "misread")}
    assert "lagophthalmos and ZELKIE26" in rows[0].text
    assert "lagophthalmos" in scans.rare_words(["of lago-", "12", "phthalmos"], {"of": 9.0})


def test_nothing_scanned(spark, scanned):
    docs, chunks, _ = scanned
    assert scans.read_pages(chunks.limit(0), spark.createDataFrame([], OCR), docs).count() == 0
    assert scans.read_pages(chunks, spark.createDataFrame([], OCR), docs.where("kind = 'none'")).count() == 0


def test_folios():
    assert all(scans.is_folio(x) for x in ("12", "[3]", "— 106 —", "Page 1 of 5", "xli", "7.", " iv "))
    assert not any(scans.is_folio(x) for x in ("", "5  79.2  7 ± 4", "mix", "A line of text", "did"))


def test_vectors_prefer_their_company():
    n = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4)):
        n[a, b] = 50
    w, c = scans.learn_vectors(n, rounds=200)
    s = w @ c.T
    assert all(s[a, b] > s[a, x] for a, b in ((0, 1), (2, 3), (4, 5)) for x in range(6) if x != b)


EASY = ["The pill is small.", "Drink some water and rest.", "It is safe to walk.", "You can eat well and read a bit.", "Do not stop on your own."]
HARD = ["Notwithstanding the heterogeneity of neuropsychological functionality, the semiparametric dysregulation, which had been hypothesised to be contingent upon proteostatic exhaustion, was recapitulated within independently ascertained cohorts.", "Multivariable structural equation modelling, parameterised with decorrelated covariates and regularised hierarchically, demonstrated that mitochondrial insufficiency substantially conveyed the longitudinal deterioration of functionality."]
MIDDLE = ["According to the local council, the new programme should reach more hospitals before the end of the year.", "People who walk regularly were less likely to report headaches, although the difference was small."]
UPPER = ["Statistical analysis was based on logistic regression, and missing values were imputed in the cohort.", "The primary outcome was the change in grip strength between entry and the final visit of the participants."]


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(3)
    pools = {1: EASY, 2: MIDDLE, 3: UPPER, 4: HARD}
    docs, level = [], {}
    for i in range(600):
        k = 1 + i % 4
        parts, n = [], 0
        while n < 60:
            s = rng.choice(pools[k] if rng.random() < 0.9 else pools[rng.choice((max(1, k - 1), min(4, k + 1)))])
            parts.append(s)
            n += len(s.split())
        docs.append((i, " ".join(parts)))
        level[i] = k
    marks = [(i, r, min(4, max(1, level[i] + rng.choice((0, 0, 0, 0, 0, 0, 1, -1))))) for i in range(0, 600, 3) for r in (1, 2)]
    return docs, marks, level


def test_held_out_levels(spark, graded):
    docs, marks, level = graded
    dirt = [(9000, None), (9001, ""), (9002, "few words"), (9003, "1 2 3\n4 5 6 " * 60), (9004, "AGTC" * 200), (9005, "这是一个关于疾病的研究。" * 60), (None, docs[0][1]), docs[0]]
    d = spark.createDataFrame(docs + dirt, "doc_id bigint, text string").withColumn("level", F.lit("clash")).withColumn("lang", F.lit("xx")).withColumn("words", F.lit(1))
    m = spark.createDataFrame(marks + [(0, 9, None), (1, 9, 77), (99999, 1, 2), (None, 1, 1)], "doc_id bigint, rater int, level int").withColumn("lang", F.lit("clash"))
    got = {r.doc_id: r.level for r in levels.grade(d, m).collect()}
    assert set(got) == set(level)
    held = [i for i in level if i % 3]
    assert sum(got[i] == level[i] for i in held) / len(held) >= 0.9


def test_no_marks_and_no_documents(spark, graded):
    d = spark.createDataFrame(graded[0][:20], "doc_id bigint, text string")
    m = spark.createDataFrame([], "doc_id bigint, rater int, level int")
    assert levels.grade(d, m).count() == 20
    assert levels.grade(d.limit(0), m).count() == 0


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    z = 2 * x[:, 0] - x[:, 1] + rng.logistic(size=2000)
    k = 1 + (z > -2).astype(int) + (z > 0) + (z > 2)
    m = levels.fit(x, k)
    assert m.weight[0] == pytest.approx(2, abs=0.3) and m.weight[1] == pytest.approx(-1, abs=0.3) and np.all(np.diff(m.bound) > 0)
    assert np.allclose(m.probabilities(x).sum(1), 1)


def test_long_documents_are_read_in_blocks(spark, scanned, monkeypatch):
    docs, chunks, want = scanned
    monkeypatch.setattr(scans, "BLOCK", 2)
    rows = scans.read_pages(chunks, spark.createDataFrame([], OCR), docs).collect()
    assert len(rows) == 36 and len({(r.doc_id, r.page) for r in rows}) == 36
    got = {(r.doc_id, r.page, m.line_no, m.kind) for r in rows for m in r.marks}
    hyphens = {x for x in want if x[3] == "hyphen"}
    assert len(hyphens & got) / len(hyphens) >= 0.95
