"""Page, chunk and OCR queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import pages
from docloom.plans.base import query
from docloom.session import table

GAP = r"[ \t\r\n\f]+"
PAGES_SQL = "SELECT doc_id, unnest(range(1, len(ps) + 1)) AS page, unnest(ps) AS text FROM (SELECT doc_id, string_split(text, chr(12)) AS ps FROM documents WHERE text IS NOT NULL)"


@query()
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return pages.chunk_documents(table(spark, folder, "documents"))


@query(
    rf"SELECT doc_id, CAST(idx AS INTEGER) AS idx, trim(substring(t, CAST(idx * 2050 + 1 AS BIGINT), 2200)) AS text FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 2200) / 2050.0)) AS BIGINT) + 1)) AS idx FROM (SELECT doc_id, trim(regexp_replace(text, '{GAP}', ' ', 'g')) AS t FROM documents) WHERE length(t) > 0)"
)
def chunk_fixed_window(spark: SparkSession, folder: str) -> DataFrame:
    return pages.fixed_windows(table(spark, folder, "documents"))


_COVER = "CASE WHEN kind = 'scan' THEN 0.9 ELSE 0.0 END"
SIGNALS_SQL = (
    f"SELECT doc_id, page, chars, words, chars >= 25 AS has_text, chars >= 25 AND lost / greatest(chars, 1) > 0.2 AS garbled, chars < 25 AND cover >= 0.5 AS is_scan, chars >= 25 AND cover >= 0.8 AND NOT lost / greatest(chars, 1) > 0.2 AS text_over_scan, "
    f"(chars < 25 AND cover >= 0.5) OR (chars >= 25 AND lost / greatest(chars, 1) > 0.2) AS needs_ocr FROM (SELECT p.doc_id, p.page, {_COVER} AS cover, length(regexp_replace(p.text, '{GAP}', '', 'g')) AS chars, "
    f"len(list_filter(regexp_split_to_array(p.text, '{GAP}'), lambda w: w <> '')) AS words, length(p.text) - length(replace(p.text, chr(65533), '')) AS lost FROM ({PAGES_SQL}) p JOIN documents d USING (doc_id))"
)


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """No table has image boxes; pages of scans count as covered by an image."""
    docs = table(spark, folder, "documents")
    cover = F.when(F.col("kind") == "scan", 0.9).otherwise(0.0)
    rows = docs.where("text is not null").select("doc_id", cover.alias("cover"), F.posexplode(F.split("text", "\f")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "cover", "text")
    return pages.page_signals(rows)


@query(SIGNALS_SQL)
def page_signals(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder)


@query(f"SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE is_scan) AS scan_pages, count(*) FILTER (WHERE needs_ocr) AS ocr_pages, count(*) FILTER (WHERE is_scan) * 2 > count(*) AS is_scanned, bool_or(has_text) AS has_any_text FROM ({SIGNALS_SQL}) GROUP BY doc_id")
def document_signals(spark: SparkSession, folder: str) -> DataFrame:
    return pages.document_signals(_signals(spark, folder))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of scanned documents as arrays of lines."""
    rows = pages.page_rows(table(spark, folder, "documents").where("kind = 'scan'"))
    return rows.select("doc_id", "page", F.split("text", "\n").alias("lines"))


_LINES_SQL = f"SELECT p.doc_id, p.page, string_split(p.text, chr(10)) AS lines FROM ({PAGES_SQL}) p JOIN documents d USING (doc_id) WHERE d.kind = 'scan'"
_TEMPLATE = r"trim(regexp_replace(strip_accents(lower(regexp_replace({c}, '[0-9]+', '#', 'g'))), '[^\p{L}\p{N}_#]+', ' ', 'g'))"
RECURRING_SQL = (
    f"WITH p AS ({_LINES_SQL}), t AS (SELECT doc_id, page, unnest(list_distinct(list_transform(lines, lambda l: {_TEMPLATE.replace('{c}', 'l')}))) AS template FROM p), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM p GROUP BY doc_id) "
    "SELECT doc_id, template, c AS pages FROM (SELECT doc_id, template, count(DISTINCT page) AS c FROM t WHERE template <> '' GROUP BY ALL) JOIN n USING (doc_id) WHERE c >= greatest(2, CAST(floor(n * 0.5 + 0.999) AS INTEGER))"
)


@query(RECURRING_SQL)
def headers_footers(spark: SparkSession, folder: str) -> DataFrame:
    return pages.recurring_lines(_lines(spark, folder))


@query(f"WITH r AS (SELECT doc_id, list(template) AS gone FROM ({RECURRING_SQL}) GROUP BY doc_id) SELECT p.doc_id, p.page, array_to_string(list_filter(p.lines, lambda l: NOT coalesce(list_contains(r.gone, {_TEMPLATE.replace('{c}', 'l')}), false)), chr(10)) AS text FROM ({_LINES_SQL}) p LEFT JOIN r USING (doc_id)")
def strip_headers(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    return pages.strip_lines(lines, pages.recurring_lines(lines))


_F = pages._FOLIO
FOLIO_SQL = (
    f"WITH p AS ({_LINES_SQL}), f AS (SELECT doc_id, page, TRY_CAST(list_filter(list_transform(list_concat(list_reverse(lines[greatest(len(lines) - 1, 1):]), lines[:2]), lambda l: regexp_extract(l, '{_F}', 1)), lambda x: x <> '')[1] AS INTEGER) AS printed FROM p), "
    "c AS (SELECT doc_id, printed - page AS o, count(*) AS c FROM f WHERE printed IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, o, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, o) AS r FROM c) WHERE r = 1), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) "
    "SELECT doc_id, o AS \"offset\" FROM b JOIN n USING (doc_id) WHERE c >= greatest(2, n // 3)"
)


@query(FOLIO_SQL)
def folio_offset(spark: SparkSession, folder: str) -> DataFrame:
    return pages.folio_offset(_lines(spark, folder))


@query(
    r"WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)), k AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM l WHERE regexp_matches(line, '^(#{1,6}[ \t]|```)')), "
    r"h AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{1,6})', 1)) AS level, trim(regexp_replace(regexp_replace(line, '^#{1,6}[ \t]+', ''), '[*_`]+', '', 'g')) AS title FROM k WHERE f % 2 = 0 AND NOT starts_with(line, '```')) "
    "SELECT a.doc_id, a.pos, a.level, a.title, max(b.pos) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level AND b.title <> '' WHERE a.title <> '' GROUP BY a.doc_id, a.pos, a.level, a.title"
)
def outline_parent(spark: SparkSession, folder: str) -> DataFrame:
    return pages.outline(table(spark, folder, "documents"))


@query()
def layout_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.layout_pages(table(spark, folder, "ocr_results"))


@query("SELECT ocr_id, coalesce(round(list_avg(list_transform(lines, lambda l: l.confidence)), 6), 0) AS confidence, len(lines) AS n FROM ocr_results WHERE lines IS NOT NULL")
def ocr_confidence(spark: SparkSession, folder: str) -> DataFrame:
    conf = F.aggregate("lines", F.lit(0.0), lambda s, l: s + l["confidence"])
    return table(spark, folder, "ocr_results").where("lines is not null").select("ocr_id", F.when(F.size("lines") == 0, 0.0).otherwise(F.round(conf / F.size("lines"), 6)).alias("confidence"), F.size("lines").alias("n"))


@query("SELECT ocr_id, round(least(1.0, coalesce(list_sum(list_transform(lines, lambda b: greatest(0.0, least(b.x1, CAST(width AS DOUBLE)) - greatest(b.x0, 0.0)) * greatest(0.0, least(b.y1, CAST(height AS DOUBLE)) - greatest(b.y0, 0.0)))), 0) / greatest(width * height, 1)), 4) AS cover FROM ocr_results WHERE lines IS NOT NULL")
def box_cover(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_results").where("lines is not null").select("ocr_id", F.round(pages.cover(F.col("lines"), F.col("width"), F.col("height")), 4).alias("cover"))


@query("SELECT ocr_id, i, round(l.x0, 3) AS x0, round(l.y0, 3) AS y0, round(l.x1, 3) AS x1, round(l.y1, 3) AS y1 FROM (SELECT ocr_id, unnest(lines) AS l, unnest(range(0, len(lines))) AS i FROM ocr_results)")
def vision_to_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes turned into shares from the lower left corner and back into pixels are as they were."""
    o = table(spark, folder, "ocr_results").select("ocr_id", "width", "height", F.posexplode("lines").alias("i", "l"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    share = o.select("ocr_id", "i", w.alias("w"), h.alias("h"), (F.col("l.x0") / w).alias("x"), (1 - F.col("l.y1") / h).alias("y"), ((F.col("l.x1") - F.col("l.x0")) / w).alias("bw"), ((F.col("l.y1") - F.col("l.y0")) / h).alias("bh"))
    x0, y0, x1, y1 = pages.to_pixels(F.col("x"), F.col("y"), F.col("bw"), F.col("bh"), F.col("w"), F.col("h"))
    return share.select("ocr_id", "i", *(F.round(c, 3).alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))


@query("WITH m AS (SELECT o.ocr_id, o.doc_id, o.page, list_sum(list_transform(lines, lambda l: length(l.text))) AS n FROM ocr_results o WHERE lines IS NOT NULL AND len(lines) > 0), p AS (" + PAGES_SQL + ") SELECT m.ocr_id, CASE WHEN m.n < 0.7 * length(p.text) THEN 'layout lost text' END AS warning FROM m JOIN p ON p.doc_id = m.doc_id AND p.page = m.page")
def cross_check(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of which one reading has much less text than the other."""
    n = F.aggregate("lines", F.lit(0), lambda s, l: s + F.coalesce(F.length(l["text"]), F.lit(0)))
    o = table(spark, folder, "ocr_results").where("size(lines) > 0").select("ocr_id", "doc_id", "page", n.alias("n"))
    p = pages.page_rows(table(spark, folder, "documents")).select("doc_id", "page", F.length("text").alias("whole"))
    return o.join(p, ["doc_id", "page"]).select("ocr_id", F.when(F.col("n") < 0.7 * F.col("whole"), "layout lost text").alias("warning"))


@query("SELECT ocr_id, array_to_string(list_transform(list_sort(list({'y0': y0, 'text': text}))[:3], lambda x: x.text), ' ') AS title FROM (SELECT *, max(size) OVER (PARTITION BY ocr_id) AS tall FROM (SELECT ocr_id, height, l.text AS text, l.y0 AS y0, l.y1 - l.y0 AS size FROM (SELECT ocr_id, height, unnest(lines) AS l FROM ocr_results)) WHERE y0 <= 0.6 * height) WHERE size >= tall - 0.6 GROUP BY ocr_id")
def biggest_lines(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "ocr_results").select(F.col("ocr_id").alias("page_key"), "height", F.explode("lines").alias("l"))
    boxes = o.select("page_key", "height", F.col("l.text").alias("text"), F.col("l.y0").alias("y0"), (F.col("l.y1") - F.col("l.y0")).alias("size"))
    return pages.biggest_lines(boxes).select(F.col("page_key").alias("ocr_id"), F.array_join(F.transform("lines", lambda x: x["text"]), " ").alias("title"))
