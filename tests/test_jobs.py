"""What follows an import, on small frames."""

import json

from pyspark.sql import functions as F

from docloom.operators import jobs


def test_heading_pages(spark):
    md = "# A\n--- end of page.page_number=0 ---\n## *B*\ntext\n--- end of page.page_number=1 ---\n# C"
    got = {r.title: r.page for r in jobs.heading_pages(spark.createDataFrame([(1, md), (2, "# D"), (3, None)], "doc_id bigint, text string")).collect()}
    assert got == {"A": 1, "B": 2, "C": 3, "D": 1}


def test_entry_state_is_terminal(spark):
    rows = [(1, "new", 1), (1, "staged", 2), (1, "new", 3), (2, "new", 1), (2, "skipped", 2)]
    got = {r.k: r.state for r in jobs.entry_state(spark.createDataFrame(rows, "k int, kind string, at int"), "k", "kind", ["at"]).collect()}
    assert got == {1: "staged", 2: "skipped"}


def test_reports(spark):
    text = "Title: A: B\nPages: 3\nno colon\nPages: 4"
    m = spark.createDataFrame([(text,)], "t string").select(jobs.tool_report(F.col("t")).alias("m")).first().m
    assert m == {"Title": "A: B", "Pages": "4"}
    table = "name      type   emb\n--------- ------ ---\nArial     TT     yes\n\nTimes New T1     no"
    assert jobs.fixed_columns(table) == [{"name": "Arial", "type": "TT", "emb": "yes"}, {"name": "Times New", "type": "T1", "emb": "no"}]
    assert jobs.fixed_columns("") == []


def test_snippets_and_names(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)) + " Tremor, end",), (None,)], "t string")
    a, b = [r.s for r in df.select(jobs.token_snippet(F.col("t"), "tremor").alias("s")).collect()]
    assert "[Tremor,]" in a and a.startswith("…") and b == ""
    names = spark.createDataFrame([("A/B", "markdown"), (None, "odd")], "t string, k string").select(jobs.output_name(F.col("t"), F.col("k"), F.lit(".x")).alias("n"))
    assert [r.n for r in names.collect()] == ["B.md", "document.x"]


def test_summaries_with_a_fake_model(spark):
    docs = spark.createDataFrame([(1, "T", "para\n\n" * 3), (2, None, " "), (3, None, "long text. " * 4000)], "doc_id bigint, title string, text string")
    reply = lambda p: '{"one_line": "ok"}' if "Notes:" in p else "no json"
    got = {r.doc_id: r for r in jobs.summarise(docs, reply, budget=1000).collect()}
    assert set(got) == {1, 3} and json.loads(got[1].card)["one_line"] == "ok" and json.loads(got[1].card)["study_type"] is None
    assert got[3].sampled and got[3].chunks_used == 4 < got[3].chunks_total


def test_keep_user_tags(spark):
    r = spark.createDataFrame([(["a"], ["b", "a", "c"])], "x array<string>, y array<string>").select(jobs.keep_user_tags(F.col("x"), F.col("y")).alias("t")).first()
    assert r.t == ["a", "b", "c"]
