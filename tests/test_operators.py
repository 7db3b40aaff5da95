"""Operators on small frames: reference vectors, brute force, and empty, null and repeated rows."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import norm
from docloom.operators import cost, graph, index, linkage, pages, search, similarity, store, tags

CHUNK = "doc_id bigint, idx int, page int, text string, norm string"


def chunks(spark, norms):
    return spark.createDataFrame([(i, 0, None, n, n) for i, n in enumerate(norms)], CHUNK)


NORMS = ["motor neuron disease and motor tone", "neuron of the cortex", "alzheimer's disease", "tone and pitch", "", "motor-driven tone of a cortex " * 3, "nothing here at all"]


def fts(query, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table t using fts5(norm, tokenize=\"{tokenizer}\")")
    db.executemany("insert into t(rowid, norm) values (?, ?)", list(enumerate(NORMS)))
    return {r: round(-s, 6) for r, s in db.execute("select rowid, bm25(t) from t where t match ?", (query,))}


@pytest.mark.parametrize("terms", [["motor"], ["motor", "tone"], ["alzheimer's"], ["cortex"]])
def test_keyword_route_scores_as_an_independent_engine(spark, terms):
    got = {r.doc_id: r.score for r in search.keyword(chunks(spark, NORMS), [[t] for t in terms], 50).collect()}
    want = fts(" AND ".join(f'"{t}"' for t in terms), "unicode61 remove_diacritics 2 tokenchars '-_'")
    assert got == pytest.approx(want, abs=2e-6)


def test_jargon_route_scores_as_an_independent_engine(spark):
    got = {r.doc_id: r.score for r in search.jargon(chunks(spark, NORMS), ["neuron"], 50).collect()}
    assert got == pytest.approx(fts('"neuron"', "trigram"), abs=2e-6)


def test_relaxes_only_when_nothing_has_all(spark):
    c = chunks(spark, NORMS)
    assert {r.doc_id for r in search.keyword(c, [["pitch"], ["absent"]], 10).collect()} == {3}
    assert {r.doc_id for r in search.keyword(c, [["tone"], ["pitch"]], 10).collect()} == {3}
    assert search.keyword(c, [], 10).count() == 0
    assert search.keyword(chunks(spark, NORMS).limit(0), [["x"]], 10).count() == 0


def test_doc_filter_keeps_the_statistics(spark):
    c = chunks(spark, NORMS)
    alone = {r.doc_id: r.score for r in search.keyword(c, [["tone"]], 10).collect()}
    some = search.keyword(c, [["tone"]], 10, spark.createDataFrame([(3,)], "doc_id bigint")).collect()
    assert [(r.doc_id, r.score) for r in some] == [(3, alone[3])]


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 0, 9.0), (2, 0, 8.0)], "doc_id bigint, idx int, score double")
    b = spark.createDataFrame([(2, 0, 1.0), (3, 0, 0.5)], "doc_id bigint, idx int, score double")
    got = [(r.doc_id, r.score, r.routes) for r in search.fuse({"keyword": a, "semantic": b}, 10).collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 5), ["keyword", "semantic"]), (1, round(1 / 61, 5), ["keyword"]), (3, round(1 / 62, 5), ["semantic"])]


def test_unknown_mode_finds_nothing(spark):
    assert search.search(chunks(spark, NORMS), None, "motor", mode="odd").count() == 0


def test_vocabulary_is_the_sum_of_documents(spark):
    docs = spark.createDataFrame([(1, "Rare word", "word word 12345 ab"), (2, None, None), (3, "Word", "")], "doc_id bigint, title string, text string")
    terms = index.doc_terms(docs)
    assert {(r.term, r.n, r.docs) for r in index.vocabulary(terms).collect()} == {("rare", 1, 1), ("word", 4, 2)}
    asked = spark.createDataFrame([("wurd",), ("word",)], "term string")
    assert [(r.term, r.alternative) for r in index.expand(asked, index.vocabulary(terms)).collect()] == [("wurd", "word")]


def test_chunker(spark):
    assert list(pages.chunk_text("")) == [] and list(pages.chunk_text(" \n\n ")) == []
    assert [p for p, _ in pages.chunk_text("one")] == [None]
    paged = list(pages.chunk_text("alpha\n\nbeta\fgamma"))
    assert paged == [(1, "alpha\n\nbeta"), (2, "gamma")]
    giant = list(pages.chunk_text("short\n\n" + "x" * 5000))
    assert len(giant) >= 3 and max(len(t) for _, t in giant) <= 2200
    small = list(pages.chunk_text("\n\n".join("word " * 12 for _ in range(20)), 120, 20))
    assert all(len(t) <= 240 for _, t in small)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\fb"), (3, "a\fb")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.idx, r.page, r.text) for r in pages.chunk_documents(docs).distinct().collect()) == [(3, 0, 1, "a"), (3, 1, 2, "b")]


def test_outline_and_fences(spark):
    md = "# A\n## B\n```\n# no\n```\n### C\n## D\n# E"
    rows = pages.outline(spark.createDataFrame([(1, md), (2, None)], "doc_id bigint, text string")).collect()
    pos = {r.title: r.pos for r in rows}
    assert {r.title: r.parent for r in rows} == {"A": None, "B": pos["A"], "C": pos["B"], "D": pos["A"], "E": None}


def test_headers_and_folios(spark):
    rows = [(1, p, [f"Journal {p}", f"line of page {'abc'[p - 1]}", str(p + 40)]) for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, lines array<string>")
    rec = pages.recurring_lines(df)
    assert {r.template for r in rec.collect()} == {"journal #", "#"}
    assert {r.text for r in pages.strip_lines(df, rec).collect()} == {"line of page a", "line of page b", "line of page c"}
    assert [(r.doc_id, r.offset) for r in pages.folio_offset(df).collect()] == [(1, 40)]


def test_layout_keeps_columns_and_gaps():
    box = lambda t, x, y: {"text": t, "x0": x, "y0": y, "x1": x + 10.0 * len(t), "y1": y + 10.0}
    text = pages.layout_text([box("left", 0, 0), box("right", 200, 1), box("below", 0, 100)])
    lines = text.split("\n")
    assert lines[0].index("right") == 20 and lines[1:4] == ["", "", ""] and lines[4] == "below"
    assert pages.layout_text([]) == ""


def test_tsv_lines(spark):
    cols = "level int, page_num int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string"
    rows = [(5, 1, 1, 1, 1, 50, 10, 20, 8, 90.0, "world"), (5, 1, 1, 1, 1, 10, 12, 30, 8, 80.0, "hello"), (5, 1, 1, 1, 2, 10, 30, 30, 8, -1.0, "next"), (4, 1, 1, 1, 1, 0, 0, 0, 0, -1.0, "")]
    got = sorted((r.text, r.x0, r.y0, r.x1, r.y1, round(r.confidence, 3)) for r in pages.tsv_lines(spark.createDataFrame(rows, cols)).collect())
    assert got == [("hello world", 10, 10, 70, 20, 0.85), ("next", 10, 30, 40, 38, 0.0)]


def test_page_signals(spark):
    rows = spark.createDataFrame([(1, 1, "", 0.9), (1, 2, "x" * 30, 0.9), (1, 3, "�" * 20 + "x" * 20, 0.0), (2, 1, "", 0.1)], "doc_id bigint, page int, text string, cover double")
    s = {(r.doc_id, r.page): r for r in pages.page_signals(rows).collect()}
    assert s[1, 1].is_scan and s[1, 2].text_over_scan and s[1, 3].garbled and s[1, 3].needs_ocr and not s[2, 1].is_scan
    d = {r.doc_id: r for r in pages.document_signals(pages.page_signals(rows)).collect()}
    assert not d[1].is_scanned and d[1].has_any_text and not d[2].has_any_text


def test_ids_and_references(spark):
    text = "See https://doi.org/10.1000/ABC. also 10.2000/own.\nPMID: 123456 PMC7654321 arXiv:2101.00001v2 ISBN 978-0-306-40615-7\nReferences\n10.3000/ref"
    ids = linkage.extract_ids(F.col("t"))
    r = spark.createDataFrame([(text,), (None,)], "t string").select(*(c.alias(k) for k, c in ids.items())).collect()
    assert (r[0].doi, r[0].pmid, r[0].pmcid, r[0].arxiv, r[0].isbn) == ("10.1000/abc", "123456", "PMC7654321", "2101.00001v2", "9780306406157")
    assert r[0].all_dois == ["10.1000/abc", "10.2000/own", "10.3000/ref"] and r[1].doi is None
    numbered = "intro\nReferences\n[1] Smith J. A first title here. J Med 1999.\n[2] Doe A, Roe B. Second long\n title. 2001.\n12\n[3] Poe C. Third title of it. 2005. doi:10.1/x\n"
    s = spark.createDataFrame([(numbered,)], "t string").select(linkage.numbered_entries(linkage.reference_section(F.col("t"))).alias("e")).first().e
    assert s == linkage.split_references(numbered.split("References")[1]) and len(s) == 3
    ay = "Hardiman, O., Chio, A. (2011). A long enough title here. Lancet.\nMiller, R. (2009). Another fine title of it. Neurology.\n"
    assert len(linkage.split_references(ay)) == 2
    read = linkage.parse_reference(F.col("t"))
    p = spark.createDataFrame([("[1] Hardiman O, Al-Chalabi A. Amyotrophic lateral sclerosis today. Lancet 2011. PMID: 12345",)], "t string").select(*(c.alias(k) for k, c in read.items())).first()
    assert (p.first_author, p.year, p.title_guess, p.pmid) == ("Hardiman O", 2011, "Amyotrophic lateral sclerosis today", "12345") or p.first_author == "Hardiman"


def test_merge_fills_only_empty(spark):
    a = spark.createDataFrame([("d", "T", "", ["x"]), ("e", None, "J", ["x"])], "k string, title string, journal string, sources array<string>")
    b = spark.createDataFrame([("d", "other", "JJ", "y"), ("d", "other", "JJ", "y"), ("z", "t", "j", "y")], "k string, title string, journal string, source string")
    got = {r.k: (r.title, r.journal, r.sources) for r in linkage.merge_records(a, b, "k", ["title", "journal"]).collect()}
    assert got == {"d": ("T", "JJ", ["x", "y"]), "e": (None, "J", ["x"])}


def test_best_candidate(spark):
    cols = "ref_id bigint, raw string, first_author string, ref_year int, work_id bigint, title string, year int, family string"
    rows = [(1, "Roe A. A study of tremor. 2001", "Roe", 2001, 10, "A study of tremor", 2001, "Roe"), (1, "Roe A. A study of tremor. 2001", "Roe", 2001, 9, "A study of tremor", 1990, "Roe"), (2, "unlike", "X", 2001, 10, "A study of tremor", 2001, "Roe")]
    assert [(r.ref_id, r.work_id, r.confidence) for r in linkage.best_candidate(spark.createDataFrame(rows, cols), "ref_id").collect()] == [(1, 10, 0.94)]


def test_candidates_need_neither_author_nor_year(spark):
    works = spark.createDataFrame([(1, "Gait after falunamab in hereditary ataxia", 2001, "Roe", "12", "345-350"), (2, "Sleep and zelofen", None, None, None, None), (3, None, 2001, "Roe", "1", "2")], "work_id bigint, title string, year int, family string, volume string, pages string")
    raws = [("Gait after falunamab in hereditary ataxia. 1994", "Doe", 1994), ("Gait after falunamab in hereditary ataxia", None, None), ("Roe A. Gait after faluna- mab in heredit ary ataxia. 2001", "Roe", 2001), ("Gait after falunarnab in hereditory ataxia. J Gait 12, 345-350", "", None), ("Sleep and zelofen, 2020", "Poe", 2020), ("Something else entirely. 2001", "Roe", 2001)]
    refs = spark.createDataFrame([(i, *x) for i, x in enumerate(raws)], "ref_id bigint, raw string, first_author string, ref_year int")
    pairs = linkage.candidate_pairs(refs, works)
    assert sorted((r.ref_id, r.work_id) for r in pairs.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]
    # two penalties refuse the first
    assert sorted((r.ref_id, r.work_id) for r in linkage.best_candidate(pairs, "ref_id").collect()) == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_copies_of_references_and_works_are_compared_once(spark):
    refs = spark.range(1500).selectExpr("id as ref_id", "'Roe A. Gait after falunamab in hereditary atoxia. 2001' as raw", "'Roe' as first_author", "2001 as ref_year")
    work = "struct('Gait after falunamab in hereditary ataxia' as title, if(id % 3 = 0, 2001, 1990) as year, 'Roe' as family, '1' as volume, '2' as pages)"
    works = spark.range(1, 1501).selectExpr("id as work_id", f"{work} as w").select("work_id", "w.*")
    texts = linkage._alike(refs)[1]
    assert linkage._met(texts, works, near_only=True).count() == 1  # of 2,250,000
    got = linkage.best_candidates(refs, works)
    assert {(r.work_id, r.confidence) for r in got.collect()} == {(3, 0.94)} and got.count() == 1500


def test_best_candidates_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    some = ["gait", "sleep", "tremor", "ataxia", "falunamab", "zelofen", "motor", "neuropathy", "cohort", "a", "of", "in"]
    works, refs = [], []
    for i in range(60):
        title = " ".join(rng.choices(some, k=rng.randint(1, 6)))
        works.append((rng.choice([i, i, None]), title, rng.choice([2000, 2001, 2005, None]), rng.choice(["Roe", "Doe", None]), rng.choice(["12", None]), "34-40"))
        letters = list(title)
        for _ in range(rng.randint(0, 5)):
            letters[rng.randrange(len(letters))] = rng.choice("aeiou ")
        refs.append((i, rng.choice([f"Roe A. {''.join(letters)}. J Gait 12, 34-40", title, f"{''.join(letters)}, 2001", "", None]), rng.choice(["roe", "Doe", "", None]), rng.choice([2000, 2002, 2010, None])))
    works = spark.createDataFrame(works, "work_id bigint, title string, year int, family string, volume string, pages string")
    refs = spark.createDataFrame(refs, "ref_id bigint, raw string, first_author string, ref_year int")
    best = {}
    for r in linkage.candidate_pairs(refs, works).collect():
        s = norm.partial_ratio(r.title.lower(), (r.raw or "").lower())
        s -= 0.3 if None not in (r.year, r.ref_year) and abs(r.year - r.ref_year) > 1 else 0
        s -= 0.15 if r.first_author and r.family and r.first_author.lower() != r.family.lower() else 0
        best[r.ref_id] = max(best.get(r.ref_id, (0, 0)), (round(s, 6), -r.work_id))
    want = {i: (-w, min(s, 0.94)) for i, (s, w) in best.items() if s >= 0.8}
    assert len(want) > 10 and {r.ref_id: (r.work_id, r.confidence) for r in linkage.best_candidates(refs, works).collect()} == want


def test_keyphrases_and_tags(spark):
    text = "Amyotrophic lateral sclerosis affects the motor neuron. The motor neuron degenerates. TDP-43 was found. Riluzole and riluzole and riluzole."
    got = [p for p, _ in tags.keyphrases(text)]
    assert "motor neuron degenerates" in [p.lower() for p in got] and tags.keyphrases("") == [] and tags.keyphrases(None) == []
    docs = spark.createDataFrame([(1, "pdf", "Riluzole 2011", text), (2, "text", None, None)], "doc_id bigint, kind string, title string, text string")
    out = {r.doc_id: r.tags for r in tags.auto_tags(docs).collect()}
    assert out[1][:2] == ["pdf", "2011"] and "riluzole" in [t.lower() for t in out[1]] and len(out[1]) <= 10 and out[2] == ["text"]
    de = spark.createDataFrame([(1, "Der Hund und die Katze sind nicht mit der Maus befreundet, und das ist gut."), (2, ""), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang for r in tags.language(de).collect()} == {1: "de", 2: None, 3: None}


def test_store_operations(spark):
    docs = spark.createDataFrame([(1, "AA", "pdf", "t"), (2, "aa", "pdf", None), (3, None, "exe", "t"), (4, None, "text", "t")], "doc_id bigint, sha256 string, kind string, text string").withColumn("batch", F.lit(0)).withColumn("extra", F.lit("x"))
    assert {r.doc_id for r in store.register(docs, docs.limit(0)).collect()} == {1, 4}
    c = store.import_counters(docs, "batch").first()
    assert (c.total, c.imported, c.skipped, c.errors) == (4, 3, 0, 1)
    rows = spark.createDataFrame([(1, "b", "Old"), (1, "a", "x")], "k bigint, v string, w string")
    assert store.first_wins(rows, ["k"], "v").first().w == "x" and store.last_wins(rows, "k", ["w"], ["v"]).first().w == "Old"
    with pytest.raises(ValueError):
        store.coalescing_update(rows, rows, "k", "nope")
    assert store.first_wins(rows.limit(0), ["k"], "v").count() == 0


def test_costs(spark):
    cols = "doc_id bigint, kind string, pages int, size_bytes bigint, ocr_pages int"
    rows = [(1, "pdf", 10, 0, 2), (2, "pdf", None, 600_000, None), (3, "audio", None, 3_000_000, None), (4, "odd", None, None, None)]
    got = {r.doc_id: (r.seconds, r.units) for r in cost.estimate(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (9.7, 10), 2: (4.7, 10), 3: (24.0, 3), 4: (0.0, 0)}
    s = spark.createDataFrame([("detect", float(i), i) for i in range(1, 6)] + [("few", 1.0, 1)], "stage string, v double, at int")
    assert {r.stage: r.per_unit for r in cost.per_unit(s, "stage", "v", ["at"]).collect()} == {"detect": pytest.approx(0.7 * 3 + 0.3 * 0.02), "few": 0.5}


def test_graph_layout_is_stable_and_in_its_box():
    edges = [(i, (i + 1) % 6, 1.0) for i in range(6)]
    a, b = graph.spring_layout(6, edges), graph.spring_layout(6, edges)
    assert np.array_equal(a, b) and a.min() >= 60 and a.max() <= 940
    assert len(graph.spring_layout(1, [])) == 1


def test_similar_to_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 4), (102, [float("nan")] * 4), (103, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.other_id) for r in similarity.similar_to(df.where("vec_id % 10 = 0"), df, 0.5).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(i, j) for i in range(0, 60, 10) for j in range(60) if i != j and round(float(u[i] @ u[j]), 6) >= 0.5}
    assert similarity.similar_to(df.limit(0), df, 0.5).count() == 0


def test_resolution_by_title(spark):
    """Against all pairs: the most similar title from 0.85 on."""
    from docloom.functions.norm import title_similarity

    titles = ["Gait speed in early dystonia", "Gait speed in late dystonia", "Sleep quality of night workers: a cohort", "Grip strength and ageing", "Effects of tofersen on motor neurons"]
    works = spark.createDataFrame([(i, t, "10.1/a" if i == 3 else None) for i, t in enumerate(titles)] + [(9, None, None), (10, titles[0], None)], "work_id bigint, title string, doi string")
    asked = ["Gait speed in early dystonia.", "<i>Sleep</i> quality of night workers - a cohort", "Something else entirely here", "Effects of tofersen on motor neurone", "short", None, "GAIT SPEED IN LATE DYSTONIA"]
    rows = spark.createDataFrame([(100 + i, t, "10.1/A" if i == 2 else None) for i, t in enumerate(asked)], "entry_id bigint, title string, doi string")
    want = {}
    for i, t in enumerate(asked):
        best = max(((round(title_similarity(t, w), 6), -j) for j, w in enumerate(titles)), default=(0, 0)) if t and len(t) > 12 else (0, 0)
        if best[0] >= 0.85:
            want[100 + i] = -best[1]
    got = {r.entry_id: r.work_id for r in linkage.by_title(rows, works, "entry_id").collect()}
    assert got == want and len(want) == 4
    both = {r.entry_id: (r.work_id, r.method) for r in linkage.resolve(rows, works, "entry_id", ["doi"]).collect()}
    assert both[102] == (3, "doi") and both[100] == (0, "title") and both[104] == (None, None) and len(both) == 7


def test_resolution_in_small_plans(spark):
    """What the driver plans at once stays small, however many steps come before."""
    works = spark.createDataFrame([(1, "Gait speed in early dystonia", "10.1/a")], "work_id bigint, title string, doi string")
    rows = spark.createDataFrame([(7, "Gait speed in early dystonia.", None), (7, "Gait speed in late dystonia", None), (8, None, "10.1/A")], "entry_id bigint, title string, doi string")
    got = linkage.resolve(rows, works, "entry_id", ["doi"])
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 4 and plan.count("Generate") == 0
    assert {r.entry_id: r.work_id for r in got.collect()} == {7: 1, 8: 1}


def test_similar_edges_and_small_columns(spark):
    from docloom.operators import graph
    from docloom.sources import adapters

    nodes = spark.createDataFrame([("a", "gait speed in dystonia"), ("b", "dystonia gait speed in"), ("c", "unrelated words only"), ("d", None), ("e", "10.1/x")], "node string, title string")
    got = {tuple(r) for r in graph.similar_edges(nodes, adapters.hashing_encoder()).collect()}
    assert got == {("a", "b", "similar", 0.5)}
    assert graph.similar_edges(nodes.limit(2), adapters.hashing_encoder()).count() == 0 == graph.similar_edges(nodes.limit(0), adapters.hashing_encoder()).count()
    w = spark.createDataFrame([("x", None, ""), (None, None, "y")], "doi string, pmid string, arxiv string").select(linkage.missing_fields(["doi", "pmid", "arxiv"]).alias("m"))
    assert [r.m for r in w.collect()] == [["pmid", "arxiv"], ["doi", "pmid"]]
    codes = linkage.codes_once(spark.createDataFrame([("s", "de", 2), ("s", "en", 1), ("s", "de", 3), ("s", None, 0), (None, "fr", 1)], "g string, c string, o int"), "g", "c", "o")
    assert [(r.g, r.codes) for r in codes.collect()] == [("s", ["en", "de"])]


def test_free_gives_back_memory_outside_the_heap(spark):
    """Freed buffers between kept ones stay with the C library after a collection of garbage alone."""
    import re
    import time
    from pathlib import Path

    from docloom.session import free

    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text()).group(1)) / 1024
    kept, gone = jvm.java.util.Vector(), jvm.java.util.Vector()
    for i in range(1500):
        (gone if i % 16 else kept).add(jvm.java.nio.ByteBuffer.allocateDirect(1 << 16))
    gone.removeAllElements()
    for _ in range(2):
        jvm.System.gc()
        time.sleep(0.5)
    before = held()
    free(spark)
    assert held() < before - 40, (before, held())
    kept.removeAllElements()
