"""What follows an import: links to full texts, tags of records, names of outputs, summaries, entry states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.columns import safe_stem
from docloom.operators.pages import chunk_text
from docloom.session import cut

#: Endings of output files by what they hold (fixed values).
SUFFIXES = {
    "layout": ".layout.txt", "markdown": ".md", "text": ".txt", "report": ".report.json", "ocr_pdf": ".ocr.pdf", "compressed": ".compressed.pdf", "pdfa": ".pdfa.pdf", "filled": ".filled.pdf",
    "encrypted": ".encrypted.pdf", "stripped": ".stripped.txt", "summary": ".summary.json", "scholar": ".scholar.json", "references": ".references.json",
}


def output_name(title: Column, key: Column, own: Column) -> Column:
    """File name of an output; an unknown kind keeps its own ending."""
    ending = own
    for k, s in SUFFIXES.items():
        ending = F.when(key == k, s).otherwise(ending)
    return F.concat(safe_stem(F.coalesce(title, F.lit("document")), 80), ending)


def pdf_urls(entries: DataFrame, works: DataFrame) -> DataFrame:
    """entry_id, url: arXiv, else an open copy by DOI, else the full text by PMID; null without any."""
    oa = works.where("doi <> '' and oa_url <> ''").groupBy(F.lower("doi").alias("d")).agg(F.min("oa_url").alias("oa"))
    pmc = works.where("pmid <> '' and pmcid <> ''").groupBy(F.col("pmid").alias("p")).agg(F.min("pmcid").alias("pmc"))
    e = entries.select("entry_id", "arxiv", F.lower("doi").alias("d"), F.col("pmid").alias("p")).join(oa, "d", "left").join(pmc, "p", "left")
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/"), F.nullif(F.col("arxiv"), F.lit("")))
    full = F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), F.col("pmc"), F.lit("/fullTextXML"))
    return e.select("entry_id", F.coalesce(arxiv, "oa", full).alias("url"))


def record_tags(works: DataFrame) -> DataFrame:
    """work_id, tags: DOI, year and journal of a record, what there is of them."""
    made = F.array(F.concat(F.lit("doi:"), F.nullif(F.col("doi"), F.lit(""))), F.col("year").cast("string"), F.nullif(F.left("journal", F.lit(40)), F.lit("")))
    return works.select("work_id", F.filter(made, lambda t: t.isNotNull()).alias("tags"))


def keep_user_tags(auto: Column, old: Column) -> Column:
    """Automatic tags first, then those of the old ones that aren't among them."""
    return F.concat(auto, F.array_except(old, auto))


def entry_state(events: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """key, state: the first of imported, staged or failed ends an entry's way; else the last event counts."""
    final = F.col(kind).isin("imported", "staged", "failed")
    ended = F.min_by(kind, F.when(final, F.struct(*order)))
    return events.groupBy(key).agg(F.coalesce(F.when(F.count_if(final) > 0, ended), F.max_by(kind, F.struct(*order))).alias("state"))


def requeue(docs: DataFrame, status: str, each: int = 200) -> DataFrame:
    """What was queued or running when the work broke off: the newest of either, at most `each`."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(status).orderBy(F.desc("created_at"), "doc_id")
    return docs.where(F.col(status).isin("queued", "running")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r")


def heading_pages(docs: DataFrame) -> DataFrame:
    """doc_id, pos, title, page: Markdown headings with their page by the separators after them.

    A heading lies on the page that the next separator ends (numbered from 0); after the last one, on
    the page following it; without any, on page 1.
    """
    from pyspark.sql.window import Window

    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    sep = F.regexp_extract(F.btrim("line"), r"^--- end of page\.page_number=(\d+) ---$", 1).try_cast("int")
    rows = lines.withColumn("sep", sep).where(F.col("sep").isNotNull() | F.col("line").rlike(r"^#{1,6}[ \t]"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    following = F.first("sep", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = F.last("sep", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    page = F.coalesce(following + 1, last + 2, F.lit(1))
    out = rows.withColumn("page", page).where(F.col("sep").isNull())
    title = F.btrim(F.regexp_replace(F.regexp_replace("line", r"^#{1,6}[ \t]+", ""), r"[*_`]+", ""))
    return out.select("doc_id", "pos", title.alias("title"), "page").where("title <> ''")


def token_snippet(text: Column, term: str, width: int = 18) -> Column:
    """width tokens around the first one equal to term, which is put in brackets; … where text is left out."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_\-]", "")))
    at = F.array_position(bare, term.lower())
    start = F.greatest(F.lit(1), at.cast("int") - width // 2)
    marked = F.transform(words, lambda w, i: F.when(i + 1 == at, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    part = F.array_join(F.slice(marked, start, width), " ")
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), part, F.when(start + width - 1 < F.size(words), F.lit("…")).otherwise(F.lit("")))


def word_lines(words: DataFrame) -> DataFrame:
    """Lines (page_key, block, line) of positioned words: text from left to right and the union of the boxes."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return words.where("trim(text) <> ''").groupBy("page_key", "block", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def tool_report(text: Column) -> Column:
    """A map of the "key: value" lines of a tool's report; the last of equal keys counts."""
    lines = F.filter(F.split(text, "\n"), lambda l: F.contains(l, F.lit(":")))
    pairs = F.transform(lines, lambda l: F.struct(F.btrim(F.substring_index(l, ":", 1)).alias("k"), F.btrim(F.substr(l, F.length(F.substring_index(l, ":", 1)) + 2)).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["k"]) == 0)
    return F.map_from_entries(kept)


def fixed_columns(report: str) -> list[dict[str, str]]:
    """Rows of a table whose columns begin where their headings do; the second line is a rule."""
    import re

    lines = report.splitlines()
    if len(lines) < 2:
        return []
    heads = [(m.start(), m.group()) for m in re.finditer(r"\S+", lines[0])]
    ends = [a for a, _ in heads[1:]] + [None]
    return [{name: line[a:b].strip() for (a, name), b in zip(heads, ends)} for line in lines[2:] if line.strip()]


#: Fields of a summary card that are null when the model leaves them out (fixed values).
CARD = (
    "one_line", "study_type", "question", "population", "sample_size", "intervention", "comparator", "primary_outcomes", "key_findings", "effect_sizes", "limitations", "funding_conflicts", "confidence", "keywords",
)


#: Characters of notes that the second question takes; the reach is the feature.
NOTES = 200_000


def _object(reply: str) -> dict | None:
    """The JSON object that a model's reply holds, whatever stands around it."""
    try:
        got = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def sections(docs: DataFrame, target: int, overlap: int) -> DataFrame:
    """doc_id, title, i, page, text, tokens (four letters each): the chunks of each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, t, i, page, text, max(1, len(text) // 4)) for d, t, x in zip(*(b.column(k).to_pylist() for k in range(3))) for i, (page, text) in enumerate(chunk_text(x or "", target, overlap))]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=["doc_id", "title", "i", "page", "text", "tokens"])

    return docs.select("doc_id", "title", "text").mapInArrow(run, "doc_id bigint, title string, i int, page int, text string, tokens int")


def summarise(docs: DataFrame, provider, budget: int = 60_000, target: int = 2400, overlap: int = 120) -> DataFrame:
    """doc_id, card (JSON), chunks_used, chunks_total, sampled: notes on each section, then one card from a document's notes.

    Map, group, reduce: sections are asked about wherever they are, so a long document is spread over
    tasks; only notes are grouped. A document beyond the budget of tokens has its sections sampled
    evenly (at least four). A reply without an object becomes a note, or a card, of its text. Blank
    documents give no row.
    """
    parts = cut(sections(docs, target, overlap), "sections")
    sized = parts.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"), F.sum("tokens").alias("all"))
    fits = F.greatest(F.lit(4), F.floor(F.col("total") * budget / F.col("all")))
    sized = sized.select("doc_id", "total", F.when(F.col("all") <= budget, F.col("total")).otherwise(F.least("total", fits)).cast("int").alias("keep"))
    # Section i is the k-th of those kept if floor(k * total / keep) = i for some k.
    k = F.ceil(F.col("i") * F.col("keep") / F.col("total"))
    taken = parts.join(sized, "doc_id").where((k < F.col("keep")) & (F.floor(k * F.col("total") / F.col("keep")) == F.col("i")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            notes = []
            for title, i, page, text, total in zip(*(b.column(c).to_pylist() for c in ("title", "i", "page", "text", "total"))):
                reply = provider(f"Section {i + 1} of {total} of {title or 'an untitled document'}{f', page {page}' if page else ''}:\n\n{text}")
                notes.append(json.dumps({**(_object(reply) or {"findings": [], "raw": reply[:500]}), "page": page}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("title"), b.column("i"), b.column("total"), pa.array(notes, pa.string())], names=["doc_id", "title", "i", "total", "note"])

    noted = cut(taken.select("doc_id", "title", "i", "page", "text", "total").mapInArrow(ask, "doc_id bigint, title string, i int, total int, note string"), "notes")
    grouped = noted.groupBy("doc_id").agg(F.first("title").alias("title"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("i", "note"))).alias("notes"))
    grouped = grouped.select("doc_id", "title", "total", F.transform("notes", lambda x: x["note"]).alias("notes"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cards, used, sampled = [], [], []
            for title, total, notes in zip(*(b.column(c).to_pylist() for c in ("title", "total", "notes"))):
                reply = provider(f"Notes: of {title or 'an untitled document'}\n[{', '.join(notes)}]"[:NOTES])
                card = dict.fromkeys(CARD) | (_object(reply) or {"one_line": reply.strip()[:500], "parse_error": True})
                used.append(len(notes))
                sampled.append(len(notes) < total)
                if sampled[-1]:
                    card["coverage_note"] = f"{len(notes)} of {total} sections were read"
                cards.append(json.dumps(card, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cards, pa.string()), pa.array(used, pa.int32()), b.column("total"), pa.array(sampled, pa.bool_())], names=["doc_id", "card", "chunks_used", "chunks_total", "sampled"])

    return grouped.mapInArrow(write, "doc_id bigint, card string, chunks_used int, chunks_total int, sampled boolean")
