"""Queries about what follows an import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.columns import build_name
from docloom.operators import index, jobs, search, store
from docloom.plans.base import query
from docloom.plans.search import _TERMS_SQL
from docloom.plans.text import NAME_SQL
from docloom.session import table


@query(
    "WITH oa AS (SELECT lower(doi) AS d, min(oa_url) AS oa FROM works WHERE doi <> '' AND oa_url <> '' GROUP BY 1), pm AS (SELECT pmid, min(pmcid) AS pmc FROM works WHERE pmid <> '' AND pmcid <> '' GROUP BY 1) "
    "SELECT e.entry_id, coalesce('https://arxiv.org/pdf/' || nullif(e.arxiv, ''), oa.oa, 'https://www.ebi.ac.uk/europepmc/webservices/rest/' || pm.pmc || '/fullTextXML') AS url FROM entries e LEFT JOIN oa ON oa.d = lower(e.doi) LEFT JOIN pm ON pm.pmid = e.pmid"
)
def pdf_url(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.pdf_urls(table(spark, folder, "entries"), table(spark, folder, "works"))


@query("SELECT work_id, array_to_string(list_filter(['doi:' || nullif(doi, ''), CAST(year AS VARCHAR), nullif(left(journal, 40), '')], lambda t: t IS NOT NULL), '|') AS tags FROM works")
def record_tags(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.record_tags(table(spark, folder, "works")).select("work_id", F.array_join("tags", "|").alias("tags"))


@query("SELECT key, array_to_string(list_concat(['zotero', item_type], list_filter(list_distinct_in_order, lambda t: NOT list_contains(['zotero', item_type], t))), '|') AS tags FROM (SELECT key, item_type, list_filter(tags, lambda t, i: list_position(tags, t) = i) AS list_distinct_in_order FROM (SELECT key, min(item_type) AS item_type, min(tags) AS tags FROM zotero_items GROUP BY key))")
def user_tags_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Automatic tags, then the user's that aren't among them."""
    items = table(spark, folder, "zotero_items").groupBy("key").agg(F.min("item_type").alias("item_type"), F.min("tags").alias("tags"))
    return items.select("key", F.array_join(jobs.keep_user_tags(F.array(F.lit("zotero"), F.col("item_type")), F.col("tags")), "|").alias("tags"))


@query("SELECT doc_id, CASE WHEN title = source THEN 'renamed' ELSE coalesce(title, 'untitled') END AS title FROM documents")
def retitled(spark: SparkSession, folder: str) -> DataFrame:
    """Only a title that is still the file's name gives way to the record's."""
    return table(spark, folder, "documents").select("doc_id", F.when(F.col("title") == F.col("source"), F.lit("renamed")).otherwise(F.coalesce("title", F.lit("untitled"))).alias("title"))


@query("SELECT user_id, coalesce(arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('imported', 'staged', 'failed')), arg_max(event_type, (ts, event_id))) AS state FROM events GROUP BY user_id")
def entry_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state machine on the event log."""
    return jobs.entry_state(table(spark, folder, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT doc_id, status FROM (SELECT doc_id, status, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, doc_id) AS r FROM (SELECT *, CASE WHEN text IS NULL THEN 'queued' WHEN kind = 'scan' THEN 'running' ELSE 'done' END AS status FROM documents) WHERE status IN ('queued', 'running')) WHERE r <= 200")
def requeued(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("text").isNull(), "queued").when(F.col("kind") == "scan", "running").otherwise("done")
    rows = table(spark, folder, "documents").select("doc_id", "created_at", status.alias("status"))
    return jobs.requeue(rows, "status").select("doc_id", "status")


@query("SELECT doc_id, kind FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT TRY_CAST(doc_id AS BIGINT) FROM refs)")
def pending_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Finished documents that wait for a summary: each at most once."""
    waiting = table(spark, folder, "refs").select(F.col("doc_id").try_cast("bigint").alias("doc_id"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "kind").join(waiting, "doc_id", "left_semi")


@query(r"WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) SELECT doc_id, pos, trim(regexp_replace(regexp_replace(line, '^#{1,6}[ \t]+', ''), '[*_`]+', '', 'g')) AS title, 1 AS page FROM l WHERE regexp_matches(line, '^#{1,6}[ \t]') AND trim(regexp_replace(regexp_replace(line, '^#{1,6}[ \t]+', ''), '[*_`]+', '', 'g')) <> ''")
def heading_pages(spark: SparkSession, folder: str) -> DataFrame:
    """No given text has page separators, so all headings lie on page 1; the tests have some."""
    return jobs.heading_pages(table(spark, folder, "documents"))


@query()
def token_snippets(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.search_documents(table(spark, folder, "documents"), "tremor", 50)
    docs = table(spark, folder, "documents").select("doc_id", "text").join(F.broadcast(hits), "doc_id")
    return docs.select("doc_id", "score", jobs.token_snippet(F.col("text"), "tremor").alias("snippet"))


@query("SELECT doc_id, left(CASE WHEN s = '' THEN 'document' ELSE s END, 80) || CASE kind WHEN 'markdown' THEN '.md' WHEN 'text' THEN '.txt' ELSE '.' || kind END AS name FROM (SELECT doc_id, kind, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(title, 'document'), '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9._ -]+', '_', 'g'), ' ._') AS s FROM documents)")
def output_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", jobs.output_name(F.col("title"), F.col("kind"), F.concat(F.lit("."), F.col("kind"))).alias("name"))


@query(f"SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM ({_TERMS_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE kind = 'scan') GROUP BY term")
def vocab_after_removal(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary when scans are removed: an anti-join and the same sum, nothing to count down."""
    docs = table(spark, folder, "documents")
    gone = docs.where("kind = 'scan'").select("doc_id")
    return index.vocabulary(index.doc_terms(docs).join(gone, "doc_id", "left_anti"))


@query("SELECT entry_id, feed_id FROM entries WHERE feed_id NOT IN (SELECT feed_id FROM feeds WHERE kind = 'arxiv')")
def feed_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Entries left when a kind of feed is removed with what hangs on it."""
    gone = table(spark, folder, "feeds").where("kind = 'arxiv'").select("feed_id")
    return table(spark, folder, "entries").select("entry_id", "feed_id").join(gone, "feed_id", "left_anti")


@query("SELECT doc_id, created_at FROM documents WHERE kind = 'pdf' AND doc_id IN (SELECT TRY_CAST(doc_id AS BIGINT) FROM refs WHERE doi IS NOT NULL) ORDER BY created_at DESC, doc_id LIMIT 20")
def graph_seed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest PDFs with a DOI in their references, at most twenty, as seeds of a graph."""
    known = table(spark, folder, "refs").where("doi is not null").select(F.col("doc_id").try_cast("bigint").alias("doc_id"))
    docs = table(spark, folder, "documents").where("kind = 'pdf'").select("doc_id", "created_at").join(known, "doc_id", "left_semi")
    return store.newest(docs, "created_at", "doc_id", 20)


@query(f"SELECT i.key, n.name || '.pdf' AS name FROM (SELECT key, min(lower(doi)) AS d FROM zotero_items GROUP BY key) i JOIN (SELECT lower(doi) AS d, min(work_id) AS work_id FROM works WHERE doi <> '' GROUP BY 1) w USING (d) JOIN ({NAME_SQL}) n ON n.work_id = w.work_id")
def title_adopted(spark: SparkSession, folder: str) -> DataFrame:
    """Items named after the work that their DOI has."""
    items = table(spark, folder, "zotero_items").groupBy("key").agg(F.min(F.lower("doi")).alias("d"))
    works = table(spark, folder, "works").where("doi <> ''").groupBy(F.lower("doi").alias("d")).agg(F.min_by(F.struct("authors", "year", "title"), "work_id").alias("w"))
    name = build_name(F.col("w.authors"), F.col("w.year"), F.col("w.title"))
    return items.join(works, "d").select("key", F.concat(name, F.lit(".pdf")).alias("name"))


@query("SELECT ocr_id, i // 5 AS block, string_agg(t, ' ' ORDER BY x0, t) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT ocr_id, i, l.text AS t, l.x0 AS x0, l.y0 AS y0, l.x1 AS x1, l.y1 AS y1 FROM (SELECT ocr_id, unnest(lines) AS l, unnest(range(0, len(lines))) AS i FROM ocr_results)) WHERE trim(t) <> '' GROUP BY 1, 2")
def word_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes joined five by five, as words are to lines."""
    o = table(spark, folder, "ocr_results").select(F.col("ocr_id").alias("page_key"), F.posexplode("lines").alias("i", "l"))
    words = o.select("page_key", F.floor(F.col("i") / 5).cast("bigint").alias("block"), F.lit(0).alias("line"), "l.text", "l.x0", "l.y0", "l.x1", "l.y1")
    return jobs.word_lines(words).select(F.col("page_key").alias("ocr_id"), "block", "text", "x0", "y0", "x1", "y1")


@query(r"SELECT doc_id, CASE WHEN ratio > 0.05 THEN 'garbled' END AS warning FROM (SELECT doc_id, CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(regexp_replace(s, '[\x{fffd}\x{e000}-\x{f8ff}\x00-\x1f\x7f-\x{9f}]', '', 'g'))) / length(s) END AS ratio FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') AS s FROM documents))")
def garble_warnings(spark: SparkSession, folder: str) -> DataFrame:
    from docloom.functions.columns import garbage_ratio

    return table(spark, folder, "documents").select("doc_id", F.when(garbage_ratio(F.col("text")) > 0.05, "garbled").alias("warning"))


@query("SELECT node, degree, round(6 + least(14.0, 3 * sqrt(degree)), 6) AS radius FROM (SELECT source AS node, count(*) AS degree FROM (SELECT DISTINCT coalesce(nullif(doi, ''), 's2:' || nullif(s2_id, ''), 't:' || lower(left(title, 60))) AS source, unnest(list_distinct(referenced_dois)) AS target FROM works) WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1)")
def node_radius(spark: SparkSession, folder: str) -> DataFrame:
    """How large a node is drawn, by the number of works it cites."""
    from docloom.operators.graph import citation_edges

    n = citation_edges(table(spark, folder, "works")).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    return n.withColumn("radius", F.round(6 + F.least(F.lit(14.0), 3 * F.sqrt("degree")), 6))
