"""Pages: chunks, page signals, headers and footers, pagination, outlines, layout, OCR lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.columns import line_template
from docloom.functions.norm import normalize
from docloom.session import spread

_BLANK = re.compile(r"\n\s*\n")


def chunk_text(text: str, target: int = 1100, overlap: int = 150) -> Iterator[tuple[int | None, str]]:
    """(page, text) of chunks of about target characters that never cross a page.

    Paragraphs gather until the next one would pass the target; the next chunk on the same page then
    begins with the last overlap characters of this one. A paragraph beyond twice the target is cut
    there and stepped back by the overlap, but for the one that opens a later page, which is only cut
    once another joins it. page is null in a text without form feed.
    """
    paged, opened = "\f" in text, False
    for number, page_text in enumerate(text.split("\f"), 1):
        page = number if paged else None
        held = ""
        for part in filter(None, map(str.strip, _BLANK.split(page_text))):
            if not held and opened:
                held = part
                continue
            opened = True
            if held and len(held) + len(part) + 2 > target:
                yield page, held.strip()
                held = f"{held[-overlap:]}\n{part}" if overlap else part
            else:
                held = f"{held}\n\n{part}" if held else part
            while len(held) > 2 * target:
                yield page, held[: 2 * target].strip()
                held = held[2 * target - overlap :]
        if held.strip():
            yield page, held.strip()


def chunk_documents(docs: DataFrame, target: int = 1100, overlap: int = 150) -> DataFrame:
    """doc_id, idx, page, text, norm of all chunks; null and blank texts give none. One Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [(d, i, p, t, normalize(t)) for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, (p, t) in enumerate(chunk_text(x, target, overlap))]
                cols = list(zip(*rows)) or [[], [], [], [], []]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "idx", "page", "text", "norm"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, idx int, page int, text string, norm string")


def fixed_windows(docs: DataFrame, width: int = 2200, overlap: int = 150) -> DataFrame:
    """doc_id, idx, text: windows of a text without paragraphs or pages, entirely in the JVM."""
    t = F.btrim(F.regexp_replace("text", r"[ \t\r\n\f]+", " "))
    step = width - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("t") - width) / F.lit(step)).cast("int"))
    rows = docs.where("doc_id is not null").select("doc_id", t.alias("t")).where("length(t) > 0")
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("doc_id", "idx", F.btrim(F.substring("t", F.col("idx") * step + 1, F.lit(width))).alias("text"))


def page_rows(docs: DataFrame) -> DataFrame:
    """doc_id, page (from 1), text: a document's pages, parted by form feeds."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\f")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


def page_signals(pages: DataFrame, least_chars: int = 25, scan_cover: float = 0.5) -> DataFrame:
    """Per page: chars, words, has_text, garbled, is_scan, text_over_scan, needs_ocr; column cover is the images' share of the page."""
    solid = F.length(F.regexp_replace("text", r"[ \t\r\n\f]+", ""))
    words = F.size(F.filter(F.split(F.col("text"), r"[ \t\r\n\f]+"), lambda w: w != ""))
    lost = F.length("text") - F.length(F.replace(F.col("text"), F.lit("�"), F.lit("")))
    base = pages.select("doc_id", "page", "cover", solid.alias("chars"), words.alias("words"), lost.alias("lost"))
    has = F.col("chars") >= least_chars
    garbled = has & (F.col("lost") / F.greatest("chars", F.lit(1)) > 0.2)
    scan = ~has & (F.col("cover") >= scan_cover)
    return base.select("doc_id", "page", "chars", "words", has.alias("has_text"), garbled.alias("garbled"), scan.alias("is_scan"), (has & (F.col("cover") >= 0.8) & ~garbled).alias("text_over_scan"), (scan | garbled).alias("needs_ocr"))


def document_signals(signals: DataFrame) -> DataFrame:
    """Per document: pages, scan pages, whether most pages are scans, whether any has text."""
    return signals.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("is_scan").alias("scan_pages"), F.count_if("needs_ocr").alias("ocr_pages"), (F.count_if("is_scan") * 2 > F.count("*")).alias("is_scanned"), F.bool_or("has_text").alias("has_any_text"))


def recurring_lines(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, template, pages: line templates on at least max(2, share) of a document's pages.

    Pages hold lines arrays; a line counts once a page. Templates are counted within their page before
    the shuffle.
    """
    per = pages.select("doc_id", "page", F.explode(F.array_distinct(F.transform("lines", line_template))).alias("template")).where("template <> ''")
    n = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    counted = per.groupBy("doc_id", "template").agg(F.countDistinct("page").alias("pages")).where("pages >= 2").join(n, "doc_id")
    return counted.where(F.col("pages") >= F.greatest(F.lit(2), (F.col("n") * share + 0.999).cast("int"))).select("doc_id", "template", "pages")


def strip_lines(pages: DataFrame, recurring: DataFrame) -> DataFrame:
    """doc_id, page, text: pages without the recurring lines, in order."""
    lists = recurring.groupBy("doc_id").agg(F.collect_set("template").alias("drop"))
    kept = F.filter("lines", lambda l: ~F.array_contains(F.coalesce("drop", F.array().cast("array<string>")), line_template(l)))
    return pages.join(lists, "doc_id", "left").select("doc_id", "page", F.array_join(kept, "\n").alias("text"))


_FOLIO = r"(?i)^[ \t]*(?:page[ \t]+)?(\d{1,4}|[ivxlcdm]{1,7})[ \t]*$"


def folio_offset(pages: DataFrame) -> DataFrame:
    """doc_id, offset: printed number minus page, where at least max(2, a third) of the pages agree; ties to the smaller.

    The printed number stands alone in the last lines, else in the first lines of a page.
    """
    n = F.size("lines")
    edge = F.concat(F.reverse(F.slice("lines", F.greatest(n - 1, F.lit(1)), 2)), F.slice("lines", 1, 2))
    folio = F.try_element_at(F.filter(F.transform(edge, lambda l: F.regexp_extract(l, _FOLIO, 1)), lambda x: x != ""), F.lit(1))
    rows = pages.where(n > 0).select("doc_id", "page", folio.try_cast("int").alias("printed"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = rows.where("printed is not null").groupBy("doc_id", (F.col("printed") - F.col("page")).alias("offset")).agg(F.count("*").alias("c"))
    best = counts.groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("offset")).alias("o"))).alias("b")).select("doc_id", "b.c", (-F.col("b.o")).alias("offset"))
    return best.join(total, "doc_id").where(F.col("c") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))).select("doc_id", "offset")


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, pos, level, title, parent: Markdown headings outside code fences; parent is the nearest heading before of a lower level.

    The parent is found by a window over the positions of each lower level, six columns wide, not by a
    join of all pairs.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    interesting = lines.where(F.col("line").rlike("^(#{1,6}[ \\t]|```)"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    fence = F.sum(F.col("line").startswith("```").cast("int")).over(w)
    heads = interesting.withColumn("open", fence % 2 == 1).where(~F.col("open") & ~F.col("line").startswith("```"))
    title = F.btrim(F.regexp_replace(F.regexp_replace("line", r"^#{1,6}[ \t]+", ""), r"[*_`]+", ""))
    heads = heads.select("doc_id", "pos", F.length(F.regexp_extract("line", "^(#{1,6})", 1)).alias("level"), title.alias("title")).where("title <> ''")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 7):
        heads = heads.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(before))
    lower = F.greatest(*[F.when(F.col("level") > k, F.col(f"at{k}")) for k in range(1, 7)])
    return heads.select("doc_id", "pos", "level", "title", lower.alias("parent"))


def layout_text(items: list[dict], widest: int = 400) -> str:
    """Text of positioned lines or words with their vertical gaps and columns kept."""
    items = sorted((i for i in items if (i["text"] or "").strip()), key=lambda i: ((i["y0"] + i["y1"]) / 2, i["x0"]))
    if not items:
        return ""
    high = median(i["y1"] - i["y0"] for i in items)
    widths = [(i["x1"] - i["x0"]) / len(i["text"]) for i in items if len(i["text"]) >= 3]
    wide = max(median(widths) if widths else high / 2, 1e-3)
    rows: list[list[dict]] = []
    anchor = 0.0
    for i in items:
        centre = (i["y0"] + i["y1"]) / 2
        if not rows or abs(centre - anchor) > high / 2:
            rows.append([])
            anchor = centre
        rows[-1].append(i)
    out: list[str] = []
    floor = None
    for row in rows:
        if floor is not None:
            out += [""] * max(0, min(3, int((min(i["y0"] for i in row) - floor) / high + 0.4)))
        line = ""
        for i in sorted(row, key=lambda i: i["x0"]):
            column = min(widest, round(i["x0"] / wide))
            line = line.ljust(column) if len(line) < column else line + " " * bool(line and line[-1] != " ")
            line += i["text"].strip()
        out.append(line.rstrip())
        floor = max(i["y1"] for i in row)
    return "\n".join(out).rstrip() + "\n"


def layout_pages(ocr: DataFrame) -> DataFrame:
    """ocr_id, text: the layout of each page's lines; a page is one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [layout_text([x for x in ls or [] if x and None not in (x["x0"], x["y0"], x["x1"], x["y1"])]) for ls in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["ocr_id", "text"])

    return ocr.select("ocr_id", "lines").mapInArrow(run, "ocr_id bigint, text string")


def tsv_lines(words: DataFrame) -> DataFrame:
    """Lines of OCR words (level, page_num, block_num, par_num, line_num, left, top, width, height, conf, text).

    Words of level 5 with text, from left to right; the union of their boxes; the mean of the
    confidences that are not negative, as a share.
    """
    key = ["page_num", "block_num", "par_num", "line_num"]
    w = words.where("level = 5 and trim(text) <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    conf = F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, F.lit(0.0))
    return w.groupBy(*key).agg(joined.alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), conf.alias("confidence"))


def to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Boxes in shares of the page from its lower left corner as pixels from the upper left one."""
    y1 = (1.0 - y) * height
    return x * width, y1 - h * height, (x + w) * width, y1


def cover(lines: Column, width: Column, height: Column) -> Column:
    """Share of the page under the boxes, clipped to it, overlaps counted twice, at most 1."""
    area = F.aggregate(lines, F.lit(0.0), lambda s, b: s + F.greatest(F.lit(0.0), F.least(b["x1"], width.cast("double")) - F.greatest(b["x0"], F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(b["y1"], height.cast("double")) - F.greatest(b["y0"], F.lit(0.0))))
    return F.least(F.lit(1.0), area / F.greatest(width * height, F.lit(1)))


def biggest_lines(boxes: DataFrame) -> DataFrame:
    """page key, lines: up to three lines in the upper 60 per cent whose height is within 0.6 of the greatest (the title)."""
    top = boxes.where(F.col("y0") <= 0.6 * F.col("height"))
    tall = F.max("size").over(Window.partitionBy("page_key"))
    kept = top.withColumn("tall", tall).where(F.col("size") >= F.col("tall") - 0.6)
    return kept.groupBy("page_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("y0", "text"))), 1, 3).alias("lines"))
