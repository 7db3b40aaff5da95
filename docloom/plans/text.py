"""Scalar text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions import html, norm
from docloom.operators.linkage import with_suffix
from docloom.plans.base import query
from docloom.session import table

GAP = r"[ \t\r\n\f]+"


@query(rf"SELECT doc_id, left(trim(regexp_replace(text, '{GAP}', ' ', 'g')), 600) AS preview FROM documents")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query(
    r"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda l: trim(ltrim(trim(l, ' ' || chr(9) || chr(12)), '#'), ' ' || chr(9) || chr(12))), "
    r"lambda l: length(l) BETWEEN 4 AND 200 AND left(l, 1) NOT IN ('|', '-', '*', '!'))[1] AS title FROM documents"
)
def title_guess(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", C.title_guess(F.col("text")).alias("title"))


@query(
    r"SELECT doc_id, left(CASE WHEN s = '' THEN 'document' ELSE s END, 120) AS stem FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '^.*/', ''), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._ -]+', '_', 'g'), ' ._') AS s FROM documents)"
)
def safe_stem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", C.safe_stem(F.col("title")).alias("stem"))


@query(r"SELECT entry_id, coalesce(regexp_matches(link, '(?i)^https?://[^/?#]+'), false) AS is_url, regexp_extract(link, '^[a-z]+://([^/?#]+)', 1) AS host FROM entries WHERE link IS NOT NULL")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries").where("link is not null").select("entry_id", C.is_url(F.col("link")).alias("is_url"), F.regexp_extract("link", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query(
    r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?is)<title[^>]*>.*?</title>') THEN trim(replace(replace(replace(replace(replace(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) END AS title FROM documents".replace('\\"', '"')
)
def html_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", html.title_column(F.col("text")).alias("title"))


@query()
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("kind = 'html' and text is not null")
    return rows.select("doc_id", html.html_text_udf("text").alias("text"))


@query(rf"SELECT work_id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]+>', '', 'g'), '{GAP}', ' ', 'g')) AS title FROM works")
def clean_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "works").select("work_id", C.clean_title(F.col("title")).alias("title"))


@query(r"SELECT ref_id, trim(regexp_replace(strip_accents(lower(regexp_replace(raw, '[0-9]+', '#', 'g'))), '[^\p{L}\p{N}_#]+', ' ', 'g')) AS template FROM refs")
def line_template(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "refs").select("ref_id", C.line_template(F.col("raw")).alias("template"))


@query(
    r"SELECT doc_id, CASE WHEN length(s) = 0 THEN 0 ELSE round((length(s) - length(regexp_replace(s, '[\x{fffd}\x{e000}-\x{f8ff}\x00-\x1f\x7f-\x{9f}]', '', 'g'))) / length(s), 6) END AS ratio "
    r"FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') AS s FROM documents)"
)
def garbage_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.round(C.garbage_ratio(F.col("text")), 6).alias("ratio"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', b / 1048576.0::DOUBLE) || ' MB' END AS size FROM (SELECT doc_id, n_chars * 7 AS b FROM documents)")
def human_size(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", C.human_size(F.col("n_chars") * 7).alias("size"))


@query("SELECT doc_id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN CAST(CAST(floor(a / 60) AS BIGINT) AS VARCHAR) || ' min ago' WHEN a < 86400 THEN CAST(CAST(floor(a / 3600) AS BIGINT) AS VARCHAR) || ' h ago' ELSE strftime(created_at, '%d %b %Y') END AS seen FROM (SELECT doc_id, created_at, CAST(floor(epoch(m)) - floor(epoch(created_at)) AS BIGINT) AS a FROM documents, (SELECT max(created_at) AS m FROM documents))")
def human_when(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "created_at")
    now = docs.agg(F.max("created_at").alias("m"))
    age = F.unix_seconds(F.col("m").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return docs.crossJoin(F.broadcast(now)).select("doc_id", C.human_when(age, F.col("created_at")).alias("seen"))  # one row




def _tidy(expr: str, n: int) -> str:
    return r"rtrim(left(regexp_replace(trim(regexp_replace(coalesce(" + expr + r", ''), '[\\/:*?" + '"' + r"<>|\x00-\x1f]', '', 'g')), '" + GAP + r"', ' ', 'g'), " + str(n) + "))"


_WHO = "CASE WHEN coalesce(len(authors), 0) = 0 THEN 'Unknown' WHEN len(authors) = 1 THEN authors[1].family WHEN len(authors) = 2 THEN authors[1].family || ' and ' || authors[2].family ELSE authors[1].family || ' et al.' END"
NAME_SQL = f"SELECT work_id, CASE WHEN n = '' THEN 'document' ELSE n END AS name FROM (SELECT work_id, rtrim({_tidy(_tidy(_WHO, 60) + chr(32) + '|| ' + chr(39) + ' - ' + chr(39) + ' || coalesce(CAST(year AS VARCHAR), ' + chr(39) + 'n.d.' + chr(39) + ') || ' + chr(39) + ' - ' + chr(39) + ' || ' + _tidy('title', 90), 200)}, ' .') AS n FROM works)"


@query(NAME_SQL)
def rename_build(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "works").select("work_id", C.build_name(F.col("authors"), F.col("year"), F.col("title")).alias("name"))


@query(f"SELECT work_id, name || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END || '.pdf' AS target FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY work_id) AS r FROM ({NAME_SQL}))")
def rename_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Unique targets: a name taken by an earlier work gets a number."""
    return with_suffix(rename_build(spark, folder), "name", "work_id", ".pdf")


_E = "coalesce({c}, '') <> ''"
CITATION_SQL = (
    "SELECT work_id, array_to_string(list_filter([coalesce(authors[1].family, '') || CASE WHEN coalesce(len(authors), 0) > 1 THEN ' et al.' ELSE '' END, coalesce(CAST(year AS VARCHAR), ''), coalesce(title, ''), coalesce(journal, '')], lambda x: x <> ''), '. ') "
    f"|| CASE WHEN {_E.format(c='volume')} THEN ' ' || volume || CASE WHEN {_E.format(c='issue')} THEN '(' || issue || ')' ELSE '' END ELSE '' END "
    f"|| CASE WHEN {_E.format(c='pages')} THEN ':' || pages ELSE '' END || CASE WHEN {_E.format(c='doi')} THEN '. https://doi.org/' || doi ELSE '' END AS citation FROM works"
)


@query(CITATION_SQL)
def citation(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "works")
    return w.select("work_id", C.citation({c: F.col(c) for c in ("authors", "year", "title", "journal", "volume", "issue", "pages", "doi")}).alias("citation"))


_ISBN_FRAME = [("978-0-306-40615-7",), ("9780306406158",), ("0-306-40615-2",), ("080442957X",), ("0804429570",), ("12345",), ("",), ("97803064061X7",)]
_ISBN_VALUES = ", ".join(f"('{x[0]}')" for x in _ISBN_FRAME)
_DIGITS = "list_sum(list_transform(range(1, {n}), lambda i: {w} * coalesce(CASE WHEN d[i] = 'X' THEN 10 ELSE TRY_CAST(d[i] AS INTEGER) END, 0)))"


@query(
    f"SELECT raw, CASE WHEN regexp_full_match(d, '[0-9]{{9}}[0-9X]') AND {_DIGITS.format(n=11, w='(11 - i)')} % 11 = 0 THEN d WHEN regexp_full_match(d, '[0-9]{{13}}') AND {_DIGITS.format(n=14, w='(CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)')} % 10 = 0 THEN d END AS isbn "
    rf"FROM (SELECT raw, upper(regexp_replace(raw, '[ \t\r\n\f\-]', '', 'g')) AS d FROM (VALUES {_ISBN_VALUES}) v(raw))"
)
def isbn_valid(spark: SparkSession, folder: str) -> DataFrame:
    """No given table has ISBNs, so these are the test vectors."""
    return spark.createDataFrame(_ISBN_FRAME, "raw string").select("raw", C.isbn_valid(F.col("raw")).alias("isbn"))


_DOI = r"10\.[0-9]{4,9}/[^ \t\r\n\f\"''<>()\[\]{}]+".replace('\\"', '"')
DOI_SQL = (
    r"lower(regexp_replace(rtrim(CASE WHEN regexp_extract({c}, '(?i)doi\.org/(@)', 1) <> '' THEN regexp_extract({c}, '(?i)doi\.org/(@)', 1) WHEN regexp_extract({c}, '(?i)(?:^|[^0-9A-Za-z_])(@)', 1) <> '' "
    r"THEN regexp_extract({c}, '(?i)(?:^|[^0-9A-Za-z_])(@)', 1) ELSE trim({c}, ' ' || chr(9) || chr(13) || chr(10)) END, '.,;:)]}>''" + '"' + r"'), '(?is)\.(?:Received|Accepted|Published|Copyright|Available)(?:[^0-9A-Za-z_].*)?$', ''))"
).replace("@", _DOI)


@query("SELECT entry_id, " + DOI_SQL.replace("{c}", "doi") + " AS doi FROM entries WHERE doi IS NOT NULL")
def doi_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries").where("doi is not null").select("entry_id", C.normalize_doi(F.col("doi")).alias("doi"))


@query("SELECT p_partkey, CASE WHEN s >= 85 THEN 72 WHEN s >= 65 THEN 110 WHEN s >= 40 THEN 150 WHEN s >= 15 THEN 220 ELSE 300 END AS dpi, CASE WHEN s >= 85 THEN 40 WHEN s >= 65 THEN 55 WHEN s >= 40 THEN 70 WHEN s >= 15 THEN 82 ELSE 90 END AS quality FROM (SELECT p_partkey, greatest(0, least(100, CAST(p_size * 3 - 10 AS INTEGER))) AS s FROM part)")
def level_for(spark: SparkSession, folder: str) -> DataFrame:
    s = C.level_for(F.col("p_size") * 3 - 10)
    return table(spark, folder, "part").select("p_partkey", s["dpi"].alias("dpi"), s["quality"].alias("quality"))


_STAGE_NAMES = list(C.STAGES) + ["other"]


@query(
    "SELECT event_id, round(least(99.0, b + s * CASE WHEN total = 0 THEN 1.0 ELSE done / total END), 1) AS percent FROM (SELECT event_id, CAST(event_id % 11 AS DOUBLE) AS done, CAST(event_id % 3 * 10 AS DOUBLE) AS total, "
    + "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {C.STAGES[n][0]}" for i, n in enumerate(C.STAGES)) + " ELSE 0 END AS b, "
    + "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {C.STAGES[n][1]}" for i, n in enumerate(C.STAGES)) + " ELSE 100 END AS s FROM events)"
)
def stage_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of invented stages, one to each event."""
    stage = F.element_at(F.array(*[F.lit(n) for n in _STAGE_NAMES]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", C.stage_percent(stage, (F.col("event_id") % 11).cast("double"), (F.col("event_id") % 3 * 10).cast("double")).alias("percent"))


@query("SELECT event_id, props AS reply FROM events WHERE json_valid(props) AND left(trim(props), 1) = '{'")
def json_reply(spark: SparkSession, folder: str) -> DataFrame:
    """The object in a reply: events' props within a fence and chatter."""
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, folder, "events").select("event_id", C.json_reply(wrapped).alias("reply")).where("reply is not null")


@query("SELECT doc_id, greatest(1, CAST(floor(length(coalesce(text, '')) / 4) AS INTEGER)) AS tokens FROM documents")
def approx_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", C.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT kind, CAST(sum(greatest(1, CAST(floor(length(coalesce(text, '')) / 4) AS INTEGER))) AS BIGINT) AS tokens FROM documents GROUP BY kind")
def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("kind").agg(F.sum(C.approx_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT entry_id, CAST(nullif(regexp_extract(published, '{C.YEAR}', 1), '') AS INTEGER) AS year FROM entries")
def published_year(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries").select("entry_id", C.first_year(F.col("published")).alias("year"))


@query("SELECT entry_id, coalesce(nullif(guid, ''), nullif(link, ''), sha1(coalesce(title, '') || coalesce(link, ''))) AS guid, sha256(coalesce(guid, '')) AS hash FROM entries")
def guid_coalesced(spark: SparkSession, folder: str) -> DataFrame:
    """A feed entry's identity: its id, else its link, else a hash of title and link."""
    e = table(spark, folder, "entries")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    made = F.sha1(F.concat(F.coalesce("title", F.lit("")), F.coalesce("link", F.lit(""))))
    return e.select("entry_id", F.coalesce(blank("guid"), blank("link"), made).alias("guid"), F.sha2(F.coalesce("guid", F.lit("")), 256).alias("hash"))


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'document' ELSE left(s, 180) END AS name FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(title, '^.*/', ''), '[^\p{L}\p{N}_.\- ()\[\]&,+'']+', '_', 'g'), ' .') AS s FROM documents)")
def display_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", C.display_name(F.col("title")).alias("name"))


@query()
def normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", norm.normalize_udf("text").alias("norm"))


@query()
def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(norm.tokens_udf("text")).alias("n_tokens"))


@query("SELECT w.work_id, round(jaro_winkler_similarity(lower(w.family), lower(r.first_author)), 6) AS jw FROM (SELECT work_id, doi, authors[1].family AS family FROM works WHERE regexp_full_match(authors[1].family, '[A-Za-z ]+')) w JOIN (SELECT doi, min(first_author) AS first_author FROM refs WHERE regexp_full_match(first_author, '[A-Za-z ]+') GROUP BY doi) r USING (doi) WHERE w.doi IS NOT NULL")
def name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Jaro-Winkler of a work's first author and what a citation of it says, both plain letters."""
    plain = "^[A-Za-z ]+$"
    w = table(spark, folder, "works").where("doi is not null").select("work_id", "doi", F.try_element_at("authors", F.lit(1))["family"].alias("family")).where(F.col("family").rlike(plain))
    r = table(spark, folder, "refs").where(F.col("first_author").rlike(plain)).groupBy("doi").agg(F.min("first_author").alias("first_author"))
    return w.join(r, "doi").select("work_id", F.round(norm.similarity_udf(F.lower("family"), F.lower("first_author")), 6).alias("jw"))


@query("SELECT entry_id, 'https://export.arxiv.org/api/query?search_query=' || url_encode(title) || '&sortBy=submittedDate&sortOrder=descending&max_results=50' AS url FROM entries WHERE regexp_full_match(title, '[A-Za-z0-9]+( [A-Za-z0-9]+)*')")
def arxiv_query_url(spark: SparkSession, folder: str) -> DataFrame:
    """The search address of a query; plain titles stand in for queries, blanks as %20."""
    e = table(spark, folder, "entries").where(F.col("title").rlike("^[A-Za-z0-9]+( [A-Za-z0-9]+)*$"))
    coded = F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20"))
    return e.select("entry_id", F.concat(F.lit("https://export.arxiv.org/api/query?search_query="), coded, F.lit("&sortBy=submittedDate&sortOrder=descending&max_results=50")).alias("url"))
