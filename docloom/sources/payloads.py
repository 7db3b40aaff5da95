"""Records of bibliographic services and feeds as rows: explicit schemas, no Python but for broken XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.columns import clean_title
from docloom.operators.linkage import ids_in_blob

WORK = ["doi", "title", "authors", "year", "journal", "volume", "issue", "pages", "pmid", "pmcid", "arxiv", "s2_id", "openalex_id", "cited_by", "referenced_dois", "oa_url", "source"]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _or_null(c: Column) -> Column:
    return F.nullif(F.lower(_text(c)), F.lit(""))


def _tail(c: Column) -> Column:
    return F.nullif(F.substring_index(_text(c), "/", -1), F.lit(""))


def _author(family: Column, given: Column) -> Column:
    return F.struct(_text(family).alias("family"), _text(given).alias("given"))


def _last_first(names: Column) -> Column:
    """Names in speaking order: the last word is the family name."""
    named = F.filter(names, lambda n: F.coalesce(F.btrim(n), F.lit("")) != "")

    def one(n: Column) -> Column:
        parts = F.split(F.btrim(n), r"[ \t]+")
        return _author(F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))

    return F.transform(named, one)


def _first_last(names: Column) -> Column:
    """Names with the family name first: the first blank parts them."""
    named = F.filter(F.transform(names, lambda n: F.btrim(n)), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.transform(named, lambda n: _author(F.substring_index(n, " ", 1), F.btrim(F.substr(n, F.length(F.substring_index(n, " ", 1)) + 2))))


def _work(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    """Rows in the schema of WORK; what the service doesn't say is null, empty text or an empty list."""
    texts = {c: F.lit("") for c in ("title", "journal", "volume", "issue", "pages")}
    plain = {c: F.lit(None).cast("string") for c in ("doi", "pmid", "pmcid", "arxiv", "s2_id", "openalex_id", "oa_url")}
    lists = {"authors": F.array().cast("array<struct<family:string,given:string>>"), "referenced_dois": F.array().cast("array<string>"), "year": F.lit(None).cast("int"), "cited_by": F.lit(None).cast("bigint"), "source": F.lit(source)}
    all_ = texts | plain | lists | given
    kept = [c for c in ("key",) if c in rows.columns]
    return rows.select(*kept, *(F.coalesce(all_[c], lists[c]).alias(c) if c in ("authors", "referenced_dois") else all_[c].alias(c) for c in WORK))


def _json(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with j: the parsed payload; those that are no JSON object drop out."""
    return rows.withColumn("j", F.from_json("payload", schema)).where(F.try_parse_json("payload").isNotNull() & F.col("j").isNotNull())


def crossref(rows: DataFrame) -> DataFrame:
    date = "struct<`date-parts`:array<array<int>>>"
    r = _json(rows, f"DOI string, title array<string>, `container-title` array<string>, author array<struct<family:string,given:string,name:string>>, issued {date}, `published-print` {date}, created {date}, volume string, issue string, page string, `is-referenced-by-count` bigint, reference array<struct<DOI:string>>")

    def year(f: str) -> Column:
        return F.try_element_at(F.try_element_at(F.col(f"j.{f}.date-parts"), F.lit(1)), F.lit(1))

    dois = F.filter(F.transform("j.reference", lambda x: F.lower(x["DOI"])), lambda d: d.isNotNull())
    return _work(
        r, "crossref", doi=_or_null(F.col("j.DOI")), title=clean_title(F.try_element_at("j.title", F.lit(1))), journal=_text(F.try_element_at(F.col("j.container-title"), F.lit(1))),
        authors=F.transform("j.author", lambda a: _author(F.coalesce(F.nullif(a["family"], F.lit("")), a["name"]), a["given"])), year=F.coalesce(year("issued"), year("published-print"), year("created")),
        volume=_text(F.col("j.volume")), issue=_text(F.col("j.issue")), pages=_text(F.col("j.page")), cited_by=F.col("j.is-referenced-by-count"), referenced_dois=dois,
    )


def openalex(rows: DataFrame) -> DataFrame:
    r = _json(rows, "id string, doi string, title string, display_name string, publication_year int, cited_by_count bigint, primary_location struct<source:struct<display_name:string>>, open_access struct<oa_url:string>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, authorships array<struct<author:struct<display_name:string>>>, ids struct<pmid:string>")
    first, last = F.col("j.biblio.first_page"), F.col("j.biblio.last_page")
    return _work(
        r, "openalex", openalex_id=_tail(F.col("j.id")), doi=_or_null(F.replace(F.col("j.doi"), F.lit("https://doi.org/"), F.lit(""))), title=clean_title(F.coalesce("j.title", "j.display_name")), year=F.col("j.publication_year"), cited_by=F.col("j.cited_by_count"),
        journal=_text(F.col("j.primary_location.source.display_name")), oa_url=F.col("j.open_access.oa_url"), volume=_text(F.col("j.biblio.volume")), issue=_text(F.col("j.biblio.issue")),
        pages=F.when(first.isNotNull(), F.concat(first, F.coalesce(F.concat(F.lit("-"), last), F.lit("")))).otherwise(F.lit("")), authors=_last_first(F.transform("j.authorships", lambda a: a["author"]["display_name"])), pmid=_tail(F.col("j.ids.pmid")),
    )


def semantic_scholar(rows: DataFrame) -> DataFrame:
    r = _json(rows, "paperId string, externalIds struct<DOI:string,PubMed:string,ArXiv:string>, title string, year int, venue string, citationCount bigint, openAccessPdf struct<url:string>, authors array<struct<name:string>>")
    return _work(
        r, "semanticscholar", s2_id=F.col("j.paperId"), doi=_or_null(F.col("j.externalIds.DOI")), pmid=F.col("j.externalIds.PubMed"), arxiv=F.col("j.externalIds.ArXiv"), title=clean_title(F.col("j.title")), year=F.col("j.year"), journal=_text(F.col("j.venue")),
        cited_by=F.col("j.citationCount"), oa_url=F.col("j.openAccessPdf.url"), authors=_last_first(F.transform("j.authors", lambda a: a["name"])),
    )


def pubmed(rows: DataFrame) -> DataFrame:
    r = _json(rows, "uid string, title string, fulljournalname string, source string, volume string, issue string, pages string, pubdate string, authors array<struct<name:string>>, articleids array<struct<idtype:string,value:string>>")

    def article(kind: str) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("j.articleids", lambda a: a["idtype"] == kind), lambda a: a["value"])), -1)

    return _work(
        r, "pubmed", pmid=F.nullif(F.col("j.uid"), F.lit("")), title=F.rtrim(clean_title(F.col("j.title")), F.lit(".")), journal=F.coalesce(F.nullif(F.col("j.fulljournalname"), F.lit("")), _text(F.col("j.source"))), volume=_text(F.col("j.volume")), issue=_text(F.col("j.issue")), pages=_text(F.col("j.pages")),
        year=F.left("j.pubdate", F.lit(4)).try_cast("int"), authors=_first_last(F.transform("j.authors", lambda a: a["name"])), doi=_or_null(F.coalesce(article("doi"), F.lit(""))), pmcid=article("pmc"),
    )


def europepmc(rows: DataFrame) -> DataFrame:
    r = _json(rows, "pmid string, pmcid string, doi string, title string, journalTitle string, pubYear string, authorString string, citedByCount bigint")
    names = F.transform(F.split(F.coalesce("j.authorString", F.lit("")), ","), lambda n: F.rtrim(F.btrim(n), F.lit(".")))
    return _work(r, "europepmc", pmid=F.col("j.pmid"), pmcid=F.col("j.pmcid"), doi=_or_null(F.col("j.doi")), title=F.rtrim(clean_title(F.col("j.title")), F.lit(".")), journal=_text(F.col("j.journalTitle")), year=F.col("j.pubYear").try_cast("int"), authors=_first_last(names), cited_by=F.col("j.citedByCount"))


def _local(xml: Column) -> Column:
    """XML without namespace prefixes and declarations, so that one schema reads every dialect."""
    bare = F.regexp_replace(xml, r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    return F.regexp_replace(F.regexp_replace(bare, r"<(/?)[A-Za-z][\w\-]*:", "<$1"), r"^\s*<\?xml[^>]*\?>", "")


def arxiv(rows: DataFrame) -> DataFrame:
    """The first entry of an Atom answer; no entry, no row."""
    schema = "entry array<struct<title:string,summary:string,id:string,published:string,doi:string,journal_ref:string,author:array<struct<name:string>>,link:array<struct<_title:string,_href:string>>>>"
    r = rows.withColumn("x", F.from_xml(_local(F.col("payload")), schema)).withColumn("e", F.try_element_at("x.entry", F.lit(1))).where("e is not null")
    pdf = F.try_element_at(F.filter("e.link", lambda l: l["_title"] == "pdf"), F.lit(1))["_href"]
    return _work(
        r, "arxiv", title=clean_title(F.col("e.title")), arxiv=F.nullif(F.substring_index("e.id", "/abs/", -1), F.lit("")), year=F.left("e.published", F.lit(4)).try_cast("int"), doi=_or_null(F.col("e.doi")),
        journal=F.coalesce(F.nullif(F.col("e.journal_ref"), F.lit("")), F.lit("arXiv")), authors=_last_first(F.transform("e.author", lambda a: a["name"])), oa_url=pdf,
    )


def feed_entries(rows: DataFrame) -> DataFrame:
    """(feed_id, guid, title, link, doi, arxiv, published, summary) of RSS or Atom texts (feed_id, payload).

    guid: the entry's id, else its link, else a hash of title and link. Summaries lose their markup. What
    can't be parsed gives no entries.
    """
    item = "struct<guid:string,id:string,title:string,link:string,description:string,summary:string,pubDate:string,published:string,updated:string,identifier:string,doi:string>"
    plain = F.regexp_replace(_local(F.col("payload")), r"<guid[^>]*>", "<guid>")
    plain = F.regexp_replace(plain, r"<(title|summary|description)\s[^>]*>", "<$1>")
    plain = F.regexp_replace(plain, r"<link[^>]*?href=\"([^\"]*)\"[^>]*?(?:/>|>\s*</link>)", "<link>$1</link>")
    x = F.from_xml(plain, f"channel struct<item:array<{item}>>, item array<{item}>, entry array<{item}>")
    e = rows.select("feed_id", x.alias("x")).select("feed_id", F.explode(F.coalesce("x.channel.item", "x.item", "x.entry")).alias("e"))
    link = _text(F.btrim("e.link"))
    body = F.coalesce("e.summary", "e.description", F.lit(""))
    summary = F.btrim(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"[ \t\r\n\f]+", " "))
    blob = F.concat_ws(" ", *(F.coalesce(F.col(f"e.{c}"), F.lit("")) for c in ("guid", "id", "link", "summary", "description", "title", "identifier", "doi")))
    doi, arx = ids_in_blob(blob)
    title = _text(F.btrim("e.title"))
    guid = F.coalesce(F.nullif(F.btrim(F.coalesce("e.guid", "e.id")), F.lit("")), F.nullif(link, F.lit("")), F.sha1(F.concat(title, link)))
    return e.select("feed_id", guid.alias("guid"), title.alias("title"), link.alias("link"), doi.alias("doi"), arx.alias("arxiv"), _text(F.coalesce("e.published", "e.pubDate", "e.updated")).alias("published"), summary.alias("summary"))


def zotero_items(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Items of a reference manager's API (payload: one item's JSON)."""
    r = _json(rows, "data struct<key:string,itemType:string,title:string,creators:array<struct<lastName:string,firstName:string,name:string>>,date:string,DOI:string,publicationTitle:string,bookTitle:string,tags:array<struct<tag:string>>,collections:array<string>,url:string>")
    d = lambda c: F.col(f"j.data.{c}")
    family = lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), c["name"], F.lit(""))
    creators = F.filter(F.transform(d("creators"), lambda c: F.concat(family(c), F.when(F.coalesce(c["firstName"], F.lit("")) != "", F.concat(F.lit(", "), c["firstName"])).otherwise(F.lit("")))), lambda n: n != "")
    years = F.filter(F.split(F.regexp_replace(F.coalesce(d("date"), F.lit("")), "[-/]", " "), " +"), lambda t: t.rlike(r"^\d{4}$"))
    called = F.create_map(*[F.lit(x) for k, v in (names or {"": ""}).items() for x in (k, v)])
    none = F.array().cast("array<string>")
    return r.select(
        d("key").alias("key"), _text(d("itemType")).alias("item_type"), _text(d("title")).alias("title"), F.coalesce(creators, none).alias("creators"), F.try_element_at(years, F.lit(1)).cast("int").alias("year"), _or_null(d("DOI")).alias("doi"),
        F.coalesce(F.nullif(d("publicationTitle"), F.lit("")), _text(d("bookTitle"))).alias("publication"), F.coalesce(F.filter(F.transform(d("tags"), lambda t: t["tag"]), lambda t: t != ""), none).alias("tags"),
        F.coalesce(F.transform(d("collections"), lambda k: F.coalesce(called[k], k)), none).alias("collections"), _text(d("url")).alias("url"),
    )
