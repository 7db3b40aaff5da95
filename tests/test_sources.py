"""Sources, decoders and sinks on files made on the spot."""

import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from docloom.sources import adapters, archives, files, payloads, sinks


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in members.items():
            z.writestr(n, c)
    return b.getvalue()


def tarred(members, link=None):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        for n, c in members.items():
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
        if link:
            i = tarfile.TarInfo("link")
            i.type, i.linkname = tarfile.SYMTYPE, link
            t.addfile(i)
    return b.getvalue()


def test_sniff(spark):
    rows = [
        ("a.pdf", b"%PDF-1.7 x"), ("b.txt", b"%PDF-1.4"), ("c.png", b"\x89PNG\r\n\x1a\n"), ("d.docx", zipped({"x": "1"})), ("e.zip", zipped({"[Content_Types].xml": "x"})), ("f.zip", zipped({"x": "1"})),
        ("g.epub2", zipped({"mimetype": "application/epub+zip"})), ("h.md", b"# plain"), ("i.exe", b"MZ\x00\x01"), ("j.html", b" <!DOCTYPE html><p>"), ("k.tar", tarred({"a": b"1"})), ("l.m4a", b"\x00\x00\x00\x18ftypisom"), ("m.md", b"\x00\x01\x02"), ("n.wav", b"RIFF\x00\x00\x00\x00WAVE"), ("o", None), ("p.tar.gz", gzip.compress(b"x")),
    ]
    got = {r.path: (r.kind, r.mismatch) for r in files.sniff(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {
        "a.pdf": ("pdf", False), "b.txt": ("pdf", True), "c.png": ("image", False), "d.docx": ("office", False), "e.zip": ("office", True), "f.zip": ("archive", False), "g.epub2": ("epub", False), "h.md": ("text", False),
        "i.exe": ("unknown", False), "j.html": ("html", False), "k.tar": ("archive", False), "l.m4a": ("audio", False), "m.md": ("unknown", False), "n.wav": ("audio", False), "o": ("unknown", False), "p.tar.gz": ("archive", False),
    }


def test_folder(spark, tmp_path):
    for n, c in {"a.md": b"# Title\ntext", "sub/b.html": b"<html><title>T</title><p>x</p></html>", ".hidden/c.md": b"x", "sub/.d.md": b"x", "node_modules/e.md": b"x", "f.md": b"", "x.app/g.md": b"x", "h.bin": b"\x00\x01"}.items():
        (tmp_path / n).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / n).write_bytes(c)
    rows = files.compatible(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows.collect()) == ["a.md", "b.html"]
    texts = {r.kind: (r.title, r.text) for r in files.read_texts(rows).collect()}
    assert texts == {"text": ("Title", "# Title\ntext"), "html": ("T", "T\nx\n")}
    assert {(r.kind, r.n, r.capped) for r in files.count_compatible(rows).collect()} == {("text", 1, False), ("html", 1, False)}


def test_archives(spark):
    inner = tarred({"deep.txt": b"deep"})
    rows = [
        ("a.zip", zipped({"x/ok.txt": "ok", "../up.txt": "no", "/abs.txt": "no", "__MACOSX/j": "no", "n.tar": inner, "bomb": "0" * 2_000_000})), ("b.tar", tarred({"f": b"1"}, link="/etc/passwd")),
        ("c.pdf.gz", gzip.compress(b"%PDF-")), ("d.zip", b"PK\x03\x04broken"), ("e.zip", b"nothing"), ("f.zip", None),
    ]
    got = archives.expand(spark.createDataFrame(rows, "path string, content binary")).collect()
    ok = {(r.archive, r.path): bytes(r.content) for r in got if r.content is not None}
    assert ok == {("a.zip", "x/ok.txt"): b"ok", ("a.zip", "n.tar/deep.txt"): b"deep", ("b.tar", "f"): b"1", ("c.pdf.gz", "c.pdf"): b"%PDF-"}
    why = {(r.archive, r.path): r.skipped for r in got if r.content is None}
    assert why["a.zip", "../up.txt"] == "unsafe or ignored" and why["a.zip", "bomb"] == "suspicious compression ratio" and why["b.tar", "link"] == "link"
    assert why["e.zip", "e.zip"] == "not an archive" and ("f.zip", "f.zip") in why and any(a == "d.zip" for a, _ in why)
    small = archives.expand(spark.createDataFrame([("a.zip", zipped({"x": "12345"}))], "path string, content binary"), archives.Limits(total_bytes=3)).first()
    assert small.skipped == "archive exceeds the total extraction budget"


def payload(spark, *objects):
    return spark.createDataFrame([(str(i), o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "key string, payload string")


def test_service_payloads(spark):
    cr = payloads.crossref(payload(spark, {"DOI": "10.1/A", "title": ["A <i>T</i>"], "author": [{"family": "Roe", "given": "A"}, {"name": "Group"}], "issued": {"date-parts": [[2011, 2]]}, "reference": [{"DOI": "10.2/B"}, {}], "is-referenced-by-count": 3}, "no json", {})).collect()
    assert len(cr) == 2
    w = cr[0]
    assert (w.doi, w.title, w.year, w.cited_by, w.referenced_dois) == ("10.1/a", "A T", 2011, 3, ["10.2/b"]) and [a.family for a in w.authors] == ["Roe", "Group"]
    oa = payloads.openalex(payload(spark, {"id": "https://x/W1", "doi": "https://doi.org/10.1/A", "display_name": "T", "authorships": [{"author": {"display_name": "Ann B Roe"}}], "biblio": {"first_page": "1", "last_page": "9"}, "ids": {"pmid": "https://p/77"}})).first()
    assert (oa.openalex_id, oa.doi, oa.pages, oa.pmid, oa.authors[0].family, oa.authors[0].given) == ("W1", "10.1/a", "1-9", "77", "Roe", "Ann B")
    s2 = payloads.semantic_scholar(payload(spark, {"paperId": "p", "externalIds": {"PubMed": 5}, "title": "T", "year": 2000, "authors": [{"name": "A Roe"}]})).first()
    assert (s2.s2_id, s2.pmid, s2.year) == ("p", "5", 2000)
    pm = payloads.pubmed(payload(spark, {"uid": "9", "title": "T.", "pubdate": "2001 Jan", "authors": [{"name": "Roe AB"}], "articleids": [{"idtype": "doi", "value": "10.1/Q"}]})).first()
    assert (pm.pmid, pm.title, pm.year, pm.doi, pm.authors[0].given) == ("9", "T", 2001, "10.1/q", "AB")
    ep = payloads.europepmc(payload(spark, {"pmid": "1", "title": "T.", "pubYear": "1999", "authorString": "Roe A, Poe B."})).first()
    assert ep.year == 1999 and [(a.family, a.given) for a in ep.authors] == [("Roe", "A"), ("Poe", "B")]
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://x"><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>T  x</title><published>2021-01-01</published><author><name>Ann Roe</name></author><arxiv:doi>10.1/Z</arxiv:doi></entry></feed>'
    ax = payloads.arxiv(payload(spark, atom, "<feed/>")).collect()
    assert len(ax) == 1 and (ax[0].arxiv, ax[0].title, ax[0].year, ax[0].doi, ax[0].journal) == ("2101.00001v1", "T x", 2021, "10.1/z", "arXiv")


def test_feed(spark):
    rss = '<?xml version="1.0"?><rss><channel><title>F</title><item><title>One</title><link>https://doi.org/10.1000/xyz1</link><guid isPermaLink="false">g1</guid><description>&lt;p&gt;Hello&lt;/p&gt; there</description><pubDate>Tue</pubDate></item><item><title>Two</title><link>http://arxiv.org/abs/2101.00001</link></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title type="text">Three</title><link rel="alternate" href="http://x/3"/><updated>2020</updated></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "broken")], "feed_id bigint, payload string")
    got = {(r.feed_id, r.guid): r for r in payloads.feed_entries(df).collect()}
    assert set(got) == {(1, "g1"), (1, "http://arxiv.org/abs/2101.00001"), (2, "a1")}
    assert got[1, "g1"].doi == "10.1000/xyz1" and got[1, "g1"].summary == "Hello there" and got[1, "http://arxiv.org/abs/2101.00001"].arxiv == "2101.00001" and got[2, "a1"].link == "http://x/3"


def test_zotero(spark):
    item = {"data": {"key": "K", "creators": [{"lastName": "Roe", "firstName": "A"}, {"name": "Group"}, {}], "date": "03/2011", "DOI": "10.1/X", "tags": [{"tag": "t"}], "collections": ["C1", "C2"]}}
    z = payloads.zotero_items(payload(spark, item), {"C1": "First"}).first()
    assert (z.creators, z.year, z.doi, z.tags, z.collections) == (["Roe, A", "Group"], 2011, "10.1/x", ["t"], ["First", "C2"])


def test_adapters_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "text", b"x\x0cy"), ("b", "pdf", b"")], "path string, kind string, content binary")
    got = [(r.path, r.page, r.text, r.error is None) for r in adapters.decode(df).orderBy("path", "page").collect()]
    assert got == [("a", 1, "x", True), ("a", 2, "y", True), ("b", None, None, False)]
    ch = spark.createDataFrame([(1, 0, "T", "some words"), (1, 1, None, None)], "doc_id bigint, idx int, title string, text string")
    v = adapters.embed(ch, adapters.hashing_encoder(8), "h").orderBy("idx").collect()
    assert abs(sum(x * x for x in v[0].vec) - 1) < 1e-6 and not any(v[1].vec)
    assert adapters.complete(spark.createDataFrame([("k", "p")], "key string, prompt string"), str.upper).first().reply == "P"
    docs = spark.createDataFrame([(1234567, "A/B?", 2011, "t")], "doc_id bigint, title string, year int, text string")
    sinks.publish(docs, str(tmp_path / "out"))
    sinks.publish(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("bundle").collect()[0][0] == "2011/B (123456)" or spark.read.parquet(str(tmp_path / "out")).count() == 1
    sinks.append_audit(spark.createDataFrame([(1, "e", "d")], "ts int, event string, detail string"), str(tmp_path / "log"))
    sinks.reports(docs.withColumn("x", F.lit(1)), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 1
