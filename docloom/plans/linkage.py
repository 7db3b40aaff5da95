"""Identifier, reference and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import linkage
from docloom.plans.base import query
from docloom.plans.text import _DOI, DOI_SQL
from docloom.session import table

_END = "(?:[^0-9A-Za-z_]|$)"
_IDS_SQL = (
    "SELECT ref_id, nullif(list_filter(list_transform(list_concat(regexp_extract_all(t, '(?i)doi\\.org/(@)', 1), regexp_extract_all(t, '(?i)(?:^|[^0-9A-Za-z_])(@)', 1)), lambda x: " + DOI_SQL.replace("{c}", "x") + "), lambda d: length(d) >= 8)[1], '') AS doi, "
    f"nullif(regexp_extract(t, '(?i)(?:^|[^0-9A-Za-z_])PMID:?[ \\t\\r\\n\\f]*(\\d{{5,9}}){_END}', 1), '') AS pmid, nullif(regexp_extract(t, '(?:^|[^0-9A-Za-z_])(PMC\\d{{5,9}}){_END}', 1), '') AS pmcid, "
    f"nullif(regexp_extract(t, '(?i)(?:^|[^0-9A-Za-z_])arXiv:[ \\t\\r\\n\\f]*(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?){_END}', 1), '') AS arxiv FROM (SELECT ref_id, left(coalesce(raw, ''), 20000) AS t FROM refs)"
).replace("@", _DOI)


@query(_IDS_SQL)
def extract_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = linkage.extract_ids(F.col("raw"))
    return table(spark, folder, "refs").select("ref_id", *(ids[k].alias(k) for k in ("doi", "pmid", "pmcid", "arxiv")))


@query()
def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All identifiers of the documents' texts."""
    ids = linkage.extract_ids(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", *(c.alias(k) for k, c in ids.items()))


_BLOB = "coalesce(guid, '') || ' ' || coalesce(link, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(title, '') || ' ' || coalesce(doi, '')"


@query(
    "SELECT entry_id, CASE WHEN d <> '' THEN " + DOI_SQL.replace("{c}", "d") + " END AS doi FROM (SELECT entry_id, CASE WHEN regexp_extract(b, '(?i)doi\\.org/(@)', 1) <> '' THEN regexp_extract(b, '(?i)doi\\.org/(@)', 1) ELSE regexp_extract(b, '(?i)(?:^|[^0-9A-Za-z_])(@)', 1) END AS d ".replace("@", _DOI)
    + f"FROM (SELECT entry_id, {_BLOB} AS b FROM entries))"
)
def entry_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The identifiers in all that a feed entry says."""
    blob = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("guid", "link", "summary", "title", "doi")))
    return table(spark, folder, "entries").select("entry_id", linkage.ids_in_blob(blob)[0].alias("doi"))


@query(
    "WITH w AS (SELECT min(work_id) AS work_id, lower(doi) AS doi FROM works WHERE doi <> '' GROUP BY 2), a AS (SELECT min(work_id) AS work_id, lower(arxiv) AS arxiv FROM works WHERE arxiv <> '' GROUP BY 2), p AS (SELECT min(work_id) AS work_id, lower(pmid) AS pmid FROM works WHERE pmid <> '' GROUP BY 2) "
    "SELECT e.entry_id, coalesce(w.work_id, a.work_id, p.work_id) AS work_id, CASE WHEN w.work_id IS NOT NULL THEN 'doi' WHEN a.work_id IS NOT NULL THEN 'arxiv' WHEN p.work_id IS NOT NULL THEN 'pmid' END AS method FROM entries e LEFT JOIN w ON w.doi = lower(e.doi) LEFT JOIN a ON a.arxiv = lower(e.arxiv) LEFT JOIN p ON p.pmid = lower(e.pmid)"
)
def resolve_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.by_priority(table(spark, folder, "entries"), table(spark, folder, "works"), "entry_id", ["doi", "arxiv", "pmid"])


@query()
def resolve_records(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with their work: by identifier, else by title from 0.85 on."""
    return linkage.resolve(table(spark, folder, "entries"), table(spark, folder, "works"), "entry_id", ["doi", "arxiv", "pmid"])


@query("SELECT work_id, list_filter(['doi', 'pmid', 'pmcid', 'arxiv', 'oa_url'], lambda f: NOT list_contains(list_filter([CASE WHEN doi <> '' THEN 'doi' END, CASE WHEN pmid <> '' THEN 'pmid' END, CASE WHEN pmcid <> '' THEN 'pmcid' END, CASE WHEN arxiv <> '' THEN 'arxiv' END, CASE WHEN oa_url <> '' THEN 'oa_url' END], lambda x: x IS NOT NULL), f)) AS missing FROM works")
def fields_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Asked fields that a record leaves empty, in the order asked."""
    return table(spark, folder, "works").select("work_id", linkage.missing_fields(["doi", "pmid", "pmcid", "arxiv", "oa_url"]).alias("missing"))


@query("SELECT source, string_agg(lang, '+' ORDER BY place) AS langs FROM (SELECT source, lang, min(doc_id) AS place FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) GROUP BY source")
def source_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language codes of a source, each once, in the order in which they first came."""
    return linkage.codes_once(table(spark, folder, "documents"), "source", "lang", "doc_id").select("source", F.array_join("codes", "+").alias("langs"))


@query(
    "WITH w AS (SELECT min(work_id) AS work_id, lower(doi) AS doi FROM works WHERE doi <> '' GROUP BY 2), p AS (SELECT min(work_id) AS work_id, lower(pmid) AS pmid FROM works WHERE pmid <> '' GROUP BY 2), "
    "r AS (SELECT r.ref_id, r.doc_id, CASE WHEN w.work_id IS NOT NULL THEN 0.98 WHEN p.work_id IS NOT NULL THEN 0.95 END AS c FROM refs r LEFT JOIN w ON w.doi = lower(r.doi) LEFT JOIN p ON p.pmid = lower(r.pmid)) SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE c >= 0.8) AS resolved FROM r GROUP BY doc_id"
)
def reference_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many references of a document have a work by identifier."""
    refs = table(spark, folder, "refs")
    found = linkage.by_priority(refs, table(spark, folder, "works"), "ref_id", ["doi", "pmid"])
    sure = F.when(F.col("method") == "doi", 0.98).when(F.col("method") == "pmid", 0.95)
    return refs.select("ref_id", "doc_id").join(found, "ref_id").groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(sure >= 0.8).alias("resolved"))


_FIELDS = ["title", "journal", "pmid", "pmcid"]
_MERGE_SQL = (
    "WITH o AS (SELECT lower(doi) AS doi, " + ", ".join(f"min(nullif({f}, '')) AS {f}" for f in ("title", "publication")) + " FROM zotero_items WHERE doi IS NOT NULL GROUP BY 1) "
    "SELECT w.work_id, coalesce(nullif(w.title, ''), o.title) AS title, coalesce(nullif(w.journal, ''), o.publication) AS journal, array_to_string(CASE WHEN o.doi IS NULL OR list_contains(w.sources, 'zotero') THEN w.sources ELSE list_append(w.sources, 'zotero') END, '|') AS sources "
    "FROM (SELECT *, lower(doi) AS d FROM works) w LEFT JOIN o ON o.doi = w.d"
)


@query(_MERGE_SQL)
def work_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Works with empty fields filled from the reference manager's items of the same DOI."""
    items = table(spark, folder, "zotero_items").where("doi is not null").select(F.lower("doi").alias("d"), "title", F.col("publication").alias("journal"), F.lit("zotero").alias("source"))
    works = table(spark, folder, "works").withColumn("d", F.lower("doi")).select("work_id", "d", "title", "journal", "sources")
    per = items.groupBy("d").agg(F.min(F.nullif(F.col("title"), F.lit(""))).alias("o_title"), F.min(F.nullif(F.col("journal"), F.lit(""))).alias("o_journal"), F.min("source").alias("o_source"))
    joined = works.join(per, "d", "left")
    sources = F.when(F.col("o_source").isNull() | F.array_contains("sources", "zotero"), F.col("sources")).otherwise(F.array_append("sources", F.col("o_source")))
    return joined.select("work_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), "o_title").alias("title"), F.coalesce(F.nullif(F.col("journal"), F.lit("")), "o_journal").alias("journal"), F.array_join(sources, "|").alias("sources"))


@query()
def refs_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """What can be read off each raw reference; patterns look back, which the SQL engine can't."""
    read = linkage.parse_reference(F.col("raw"))
    return table(spark, folder, "refs").select("ref_id", *(c.alias(k) for k, c in read.items()))


_NUMBERED = r"^[ \t\r\n\f]*(?:\[\d{1,4}\]|\d{1,4}[.)])[ \t\r\n\f]+"


@query()
def refs_section(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the documents' numbered reference lists, from text to parsed rows."""
    section = linkage.reference_section(F.col("text"))
    lists = table(spark, folder, "documents").where("text is not null").select("doc_id", linkage.numbered_entries(section).alias("e"))
    entries = lists.select("doc_id", F.posexplode("e").alias("n", "raw"))
    read = linkage.parse_reference(F.col("raw"))
    return entries.select("doc_id", (F.col("n") + 1).alias("n"), "raw", *(c.alias(k) for k, c in read.items()))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[ \t\r\n\f]*(?:\[\d{1,4}\]|\d{1,4}[.)])[ \t\r\n\f]+'))) AS numbered FROM documents WHERE text IS NOT NULL")
def refs_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that begin with a reference number."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda l: l.rlike(_NUMBERED))).alias("numbered"))


@query()
def reference_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """References with their best work by fuzzy title; another year or author costs, and none is needed."""
    refs = table(spark, folder, "refs").select("ref_id", "raw", "first_author", F.col("year").alias("ref_year"))
    works = table(spark, folder, "works").select("work_id", "title", "year", F.try_element_at("authors", F.lit(1))["family"].alias("family"), "volume", "pages")
    return linkage.best_candidates(refs, works)


@query()
def record_support(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose title a work has, with how far page and record agree."""
    docs = table(spark, folder, "documents").where("title is not null").select("doc_id", F.col("title").alias("pdf_title"), F.left("text", F.lit(3000)).alias("page"))
    works = table(spark, folder, "works").select("work_id", "title", "year", "doi", F.try_element_at("authors", F.lit(1))["family"].alias("family"))
    both = docs.join(works, F.lower("pdf_title") == F.lower("title")).withColumn("guessed_title", F.lit(""))
    return linkage.text_supports(both).select("doc_id", "work_id", "support", "verified")
