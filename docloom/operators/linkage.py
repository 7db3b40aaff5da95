"""Identifiers, references and bibliographic records: extraction, merging, resolving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.columns import DOI, clean_title, first_year, fold, found, isbn_valid, matches, normalize_doi
from docloom.functions.norm import partial_ratio_best_udf, partial_ratio_udf, title_similarity_udf
from docloom.session import cut


def with_suffix(names: DataFrame, name: str, key: str, ending: str) -> DataFrame:
    """key, target: the name, from its second holder (by key) on with a number in brackets."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(key))
    return names.withColumn("r", r).select(key, F.concat(F.col(name), F.when(F.col("r") == 1, F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("r").cast("string"), F.lit(")"))), F.lit(ending)).alias("target"))


def extract_ids(text: Column, head: int = 20_000) -> dict[str, Column]:
    """Identifiers in the first head characters (the reach is the feature).

    all_dois: DOIs in addresses first, then bare ones, each once; those before the heading of the
    references come first. The document's DOI is the first of them. arxiv: new style, address, old
    style. isbn: the first valid one. Null text gives nulls and an empty list.
    """
    t = F.left(F.coalesce(text, F.lit("")), F.lit(head))
    urls = matches(t, rf"(?i)doi\.org/({DOI})", 1)
    bare = matches(t, rf"(?i)(?:^|[^0-9A-Za-z_])({DOI})", 1)
    all_dois = F.array_distinct(F.filter(F.transform(F.concat(urls, bare), normalize_doi), lambda d: F.length(d) >= 8))
    start = F.regexp_instr(t, F.lit(r"(?i)\n[ \t\r\n\f]*(references|bibliography|literature cited)[ \t\r\n\f]*\n"))
    low = F.lower(t)
    before = F.filter(all_dois, lambda d: (start > 0) & (F.instr(low, d) < start))
    ordered = F.concat(before, F.array_except(all_dois, before))
    end = r"(?:[^0-9A-Za-z_]|$)"
    arxiv_new = found(t, rf"(?i)(?:^|[^0-9A-Za-z_])arXiv:[ \t\r\n\f]*(\d{{4}}\.\d{{4,5}}(?:v\d+)?){end}")
    arxiv_url = found(t, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)")
    arxiv_old = found(t, rf"(?i)(?:^|[^0-9A-Za-z_])arXiv:[ \t\r\n\f]*([a-z\-]+(?:\.[A-Z]{{2}})?/\d{{7}}(?:v\d+)?){end}")
    isbns = F.transform(matches(t, rf"(?i)(?:^|[^0-9A-Za-z_])ISBN(?:-1[03])?:?[ \t\r\n\f]*([\dXx][\d\- \t\r\n\f]{{8,16}}[\dXx]){end}", 1), isbn_valid)
    return {
        "doi": F.try_element_at(ordered, F.lit(1)),
        "all_dois": ordered,
        "arxiv": F.coalesce(arxiv_new, arxiv_url, arxiv_old),
        "pmid": found(t, rf"(?i)(?:^|[^0-9A-Za-z_])PMID:?[ \t\r\n\f]*(\d{{5,9}}){end}"),
        "pmcid": found(t, rf"(?:^|[^0-9A-Za-z_])(PMC\d{{5,9}}){end}"),
        "isbn": F.try_element_at(F.filter(isbns, lambda x: x.isNotNull()), F.lit(1)),
    }


def ids_in_blob(blob: Column) -> tuple[Column, Column]:
    """(doi, arxiv) of a feed entry's text."""
    url, bare = F.regexp_extract(blob, rf"(?i)doi\.org/({DOI})", 1), F.regexp_extract(blob, rf"(?i)(?:^|[^0-9A-Za-z_])({DOI})", 1)
    d = F.when(url != "", url).when(bare != "", bare)
    return normalize_doi(d), found(blob, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)")


def by_priority(rows: DataFrame, works: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """key, work_id, method: the work of the first identifier that finds one; of several works the smallest id.

    One equi-join for each identifier on its few non-null rows; a placeholder that many rows carry
    finds no work and joins to nothing.
    """
    out = rows.select(key, *ids)
    for i in ids:
        w = works.where(F.col(i).isNotNull() & (F.col(i) != "")).groupBy(F.lower(i).alias(f"_{i}")).agg(F.min("work_id").alias(f"work_{i}"))
        out = out.withColumn(f"_{i}", F.lower(i)).join(w, f"_{i}", "left").drop(f"_{i}")
    work = F.coalesce(*[F.col(f"work_{i}") for i in ids])
    method = reduce(lambda a, i: F.when(F.col(f"work_{i}").isNotNull(), F.lit(i)).otherwise(a), reversed(ids), F.lit(None).cast("string"))
    return out.select(key, work.alias("work_id"), method.alias("method"))


def merge_records(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records of first with empty fields filled from second, never overwritten; sources appended."""
    s = second.groupBy(key).agg(*(F.min(F.nullif(F.col(f), F.lit(""))).alias(f"o_{f}") for f in fields), F.min("source").alias("o_source"))
    joined = first.join(s, key, "left")
    filled = [F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"o_{f}")).alias(f) for f in fields]
    sources = F.when(F.col("o_source").isNull() | F.array_contains("sources", F.col("o_source")), F.col("sources")).otherwise(F.array_append("sources", F.col("o_source")))
    return joined.select(key, *filled, sources.alias("sources"))


# Patterns of reference entries (fixed values).
_NUMBER = r"^[ \t\r\n\f]*(?:\[\d{1,4}\]|\d{1,4}[.)])[ \t\r\n\f]+"
_NAME = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ'\-]+"
_VANCOUVER = rf"^(?:{_NAME}(?:\s{_NAME})?\s[A-Z]{{1,3}},?\s*)+(?:et al\.?,?\s*)?\.?\s*"
_APA = rf"^(?:{_NAME},\s(?:[A-Z]\.\s?)+(?:,\s|\s?&\s|\sand\s)?)+(?:et al\.?)?\s*"


def parse_reference(raw: Column) -> dict[str, Column]:
    """What can be read off a raw reference: doi, pmid, year, first_author, title_guess."""
    body = F.regexp_replace(raw, _NUMBER, "")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, _VANCOUVER, ""), _APA, ""), r"^\s*\(?(?:19|20)\d\d[a-z]?\)?\.?\s*", "")
    parts = F.transform(F.split(rest, r"(?<=[\p{L}\p{N}_]{2})[.?!]\s"), lambda c: F.btrim(c))
    titles = F.filter(parts, lambda c: (F.length(c) > 15) & ~c.rlike(r"^(?:19|20)\d\d") & ~c.rlike(rf"(?i)(?:^|[^0-9A-Za-z_]){DOI}"))
    url, bare = F.regexp_extract(raw, rf"(?i)doi\.org/({DOI})", 1), F.regexp_extract(raw, rf"(?i)(?:^|[^0-9A-Za-z_])({DOI})", 1)
    return {
        "doi": normalize_doi(F.when(url != "", url).when(bare != "", bare)),
        "pmid": found(raw, r"(?i)(?:^|[^0-9A-Za-z_])PMID:?[ \t\r\n\f]*(\d{5,9})(?:[^0-9A-Za-z_]|$)"),
        "year": F.regexp_extract(body, r"(?:^|[^0-9A-Za-z_])(19[5-9][0-9]|20[0-4][0-9])[a-z]?(?:[^0-9A-Za-z_]|$)", 1).try_cast("int"),
        "first_author": F.coalesce(found(body, rf"^({_NAME}(?:\s{_NAME})?)[,\s]"), F.lit("")),
        "title_guess": F.left(F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")), F.lit(200)),
    }


def reference_section(text: Column) -> Column:
    """The text after the last heading of a reference list, up to an end heading more than 200 characters on; '' without one."""
    heading = r"(?im)^[ \t\r\n\f]*(?:\d+\.?[ \t\r\n\f]*)?(?:references?|bibliography|literature cited|works cited|reference list|references and notes)[ \t]*$"
    parts = F.split(text, heading)
    rest = F.element_at(parts, -1)
    end = F.regexp_instr(rest, F.lit(r"(?im)^[ \t\r\n\f]*(?:appendix|supplementary|acknowledge?ments?|author contributions|figure legends?)(?:[^0-9A-Za-z_]|$)"))
    cut = F.when(end > 201, F.left(rest, end - 1)).otherwise(rest)
    return F.when(F.size(parts) < 2, F.lit("")).otherwise(F.replace(cut, F.lit("\f"), F.lit("\n")))


def numbered_entries(section: Column) -> Column:
    """Entries of a numbered list: a number at a line's start begins one; bare page numbers drop out; 20 characters at least."""
    lines = F.filter(F.transform(F.split(section, "\n"), F.rtrim), lambda l: ~l.rlike(r"^[ \t]*\d{1,4}[ \t]*$"))
    marked = F.transform(lines, lambda l: F.when(l.rlike(_NUMBER), F.concat(F.lit("\u0001"), l)).otherwise(F.concat(F.lit(" "), F.btrim(l))))
    joined = F.regexp_replace(F.array_join(marked, ""), r"([\p{L}\p{N}_])- ([\p{L}\p{N}_])", "$1$2")
    entries = F.transform(F.split(joined, "\u0001"), lambda e: F.btrim(F.regexp_replace(e, r"[ \t\r\n\f]+", " ")))
    return F.filter(entries, lambda e: F.length(e) >= 20)


def split_references(section: str) -> list[str]:
    """Entries of a reference list of either style; the author-year style depends on the text gathered so far, so it is a fold."""
    import re

    lines = [l.rstrip() for l in section.splitlines() if not re.fullmatch(r"\s*\d{1,4}\s*", l)]
    number = re.compile(r"\s*(?:\[\d{1,4}\]|\d{1,4}[.)])\s+")
    name = re.compile(rf"{_NAME},?\s+[A-Z]")
    closed = re.compile(r"(?:\.|\d{4}[a-z]?\.?|\)|doi\S*)\s*$", re.I)
    numbered = sum(bool(number.match(l)) for l in lines) >= 3
    groups: list[str] = [""]
    for l in lines:
        now = groups[-1].strip()
        if numbered:
            begins = bool(number.match(l))
        else:
            if not l.strip():
                groups.append("")
                continue
            begins = bool(now) and bool(name.match(l)) and bool(closed.search(now))
        if begins:
            groups.append(l)
        else:
            groups[-1] += ("" if not groups[-1] or groups[-1].endswith("-") else " ") + (l.strip() if groups[-1] or numbered else l)
    tidy = (" ".join(re.sub(r"(\w)- (\w)", r"\1\2", g).split()) for g in groups)
    return [g for g in tidy if len(g) >= 20]


def missing_fields(asked: list[str]) -> Column:
    """Names of the asked columns that are null or empty."""
    filled = F.array(*(F.when(F.col(c) != "", F.lit(c)) for c in asked))
    return F.array_except(F.array(*map(F.lit, asked)), filled)


def codes_once(rows: DataFrame, group: str, code: str, order: str) -> DataFrame:
    """group, codes: each code once, in the order of its first row; made unique before they are gathered, so a large group costs its codes only."""
    first = rows.where(F.col(group).isNotNull() & F.col(code).isNotNull()).groupBy(group, code).agg(F.min(order).alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(code).alias("c")))), lambda x: x["c"]).alias("codes"))


def by_title(rows: DataFrame, works: DataFrame, key: str, least: float = 0.85, shortest: int = 12) -> DataFrame:
    """key, work_id, similarity: the work of the most similar title, from `least` on, for rows (key, title) with titles of more than `shortest` letters.

    Titles meet if they share the rarest word of the work's title and one of the next two (rarity over all works'
    titles) and half of the words of the shorter; equal titles are compared once. Ties by work_id; null
    and short titles have none.
    """
    words = lambda c: F.array_distinct(F.filter(matches(fold(clean_title(F.col(c))), r"[\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    # Tables of their own: one plan of all would be planned anew after each of its many shuffles, by the driver. Keys move with ids only, titles with the pairs that met.
    w = cut(works.where("title is not null").groupBy("title").agg(F.min("work_id").alias("work_id")).select("work_id", F.col("title").alias("other"), words("title").alias("u")), "titles")
    each = w.select("work_id", F.explode("u").alias("w"))
    counted = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w")
    rare = counted.groupBy("work_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "w"))), 1, 3)["w"].alias("r"))  # a title's words
    pair = lambda a, b: F.xxhash64(F.least(a, b), F.greatest(a, b))
    of = lambda i: F.try_element_at("r", F.lit(i))
    keys = F.filter(F.array(*(F.when(of(b).isNotNull(), pair(of(a), of(b))) for a, b in ((1, 2), (1, 3)))), lambda k: k.isNotNull())
    keyed = rare.where("size(r) > 1").select("work_id", F.explode(F.array_distinct(keys)).alias("k"))
    asked = rows.where(F.col(key).isNotNull() & (F.length("title") > shortest)).groupBy("title").agg(F.min(key).alias("asks"))
    asked = cut(asked.select("asks", "title", words("title").alias("t")), "asked")
    each = asked.select("asks", "t", F.posexplode("t").alias("i", "w"))
    each = each.select("asks", F.explode(F.transform(F.slice("t", F.col("i") + 2, F.size("t")), lambda x: pair(x, F.col("w")))).alias("k"))
    met = cut(each.join(keyed, "k").select("asks", "work_id").distinct(), "met")
    most = F.size(F.array_intersect("t", "u")) * 2 >= F.least(F.size("t"), F.size("u"))
    scored = met.join(asked, "asks").join(w, "work_id").where(most).select("title", "work_id", F.round(title_similarity_udf("title", "other"), 6).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("title").agg(F.max(F.struct("similarity", (-F.col("work_id")).alias("minus"))).alias("b"))
    best = best.select("title", (-F.col("b.minus")).alias("work_id"), F.col("b.similarity").alias("similarity"))
    return rows.where(F.col(key).isNotNull()).select(key, "title").dropDuplicates([key]).join(best, "title").select(key, "work_id", "similarity")


def resolve(rows: DataFrame, works: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """key, work_id, method of rows: by identifier in the order of ids, else by title; null where neither finds one."""
    known = cut(by_priority(rows, works, key, ids), "known")
    open_ = rows.join(known.where("work_id is null").select(key), key, "left_semi").select(key, "title")
    titled = by_title(cut(open_, "open"), works, key).select(key, F.col("work_id").alias("by_title"))
    both = known.join(titled, key, "left")
    return both.select(key, F.coalesce("work_id", "by_title").alias("work_id"), F.when(F.col("work_id").isNull() & F.col("by_title").isNotNull(), F.lit("title")).otherwise(F.col("method")).alias("method"))


def candidate_pairs(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Pairs of refs (ref_id, raw, first_author, ref_year) and works (work_id, title, year, family, volume, pages) that share one of several keys.

    The title's two rarest words, whatever author and year are; one of them or the longest with the author; the rarest
    with a year at most one apart; volume and first page. A null author, year or place just makes no key.
    Words cut at a hyphen also count whole. Of works that differ in work_id only the least stands for all.
    """
    asked, r = _alike(refs.where("ref_id is not null"))
    pairs = _met(r, works)
    return asked.join(pairs, ["h1", "h2"]).select("ref_id", "raw", "first_author", "ref_year", "work_id", "title", "year", "family")


def _alike(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref_id, h1, h2) of refs, and (h1, h2, raw, first_author, ref_year) with each text, author and year once."""
    said = [F.struct(c, F.col(c).isNull()) for c in ("raw", "first_author", "ref_year")]
    rows = refs.withColumns({"h1": F.xxhash64(*said), "h2": F.xxhash64(F.lit("again"), *said)})
    return rows.select("ref_id", "h1", "h2"), rows.groupBy("h1", "h2").agg(*(F.min(c).alias(c) for c in ("raw", "first_author", "ref_year")))


def _met(refs: DataFrame, works: DataFrame, near_only: bool = False) -> DataFrame:
    """Pairs of candidate_pairs by (h1, h2), with the columns of both sides. near_only: without those whose years are known and more than one apart, which best_candidate never accepts."""
    key = lambda *c: F.xxhash64(*c)
    words = lambda c: matches(F.lower(c), r"[\p{L}\p{N}]+")
    family = lambda c: F.nullif(F.regexp_extract(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\p{L}\p{N}]+", 0), F.lit(""))
    keys = lambda *c: F.filter(F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<bigint>")) for x in c))), lambda k: k.isNotNull())

    all_words = words(clean_title(F.col("title")))
    long = F.filter(all_words, lambda w: F.length(w) > 3)
    same = works.where("title is not null").groupBy("title", "year", "family", "volume", "pages").agg(F.min("work_id").alias("work_id"), F.count("*").alias("copies")).where("work_id is not null")
    titled = cut(same.withColumn("t", F.array_distinct(F.when(F.size(long) > 0, long).otherwise(all_words))), "titled")
    each = titled.select("work_id", "copies", F.explode("t").alias("w"))
    counted = each.join(each.groupBy("w").agg(F.sum("copies").alias("n")), "w")
    rare = counted.groupBy("work_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "w"))), 1, 2)["w"].alias("rare"))
    w = titled.join(rare, "work_id", "left").withColumn("t1", F.try_element_at("rare", F.lit(1))).withColumn("t2", F.coalesce(F.try_element_at("rare", F.lit(2)), "t1")).withColumn("a", family("family"))
    first = F.nullif(F.regexp_extract(F.coalesce("pages", F.lit("")), r"\d+", 0), F.lit(""))
    volume = F.nullif(F.regexp_extract(F.coalesce("volume", F.lit("")), r"\d+", 0), F.lit(""))
    longest = F.array_max(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    author = F.when(F.col("a").isNotNull() & F.col("t1").isNotNull(), F.transform(F.array("t1", "t2", longest), lambda x: key(F.lit("author"), "a", x)))
    place = F.array(F.when(volume.isNotNull() & first.isNotNull(), key(F.lit("place"), volume, first)))
    near = F.when(F.col("t1").isNotNull(), F.transform(F.sequence(F.col("year").cast("bigint") - 1, F.col("year").cast("bigint") + 1), lambda y: key(F.lit("year"), "t1", y)))
    # Two words take one key: the rarest is met, the next one looked for in the pair. With near_only and both years that is left to the years' key.
    both = F.when((F.col("t1") == F.col("t2")) | (F.length("t1") > 3) & (F.length("t2") > 3), F.array(key(F.lit("any"), "t1"), F.when(F.col("year").isNull(), key(F.lit("none"), "t1"))))
    of_work = w.select("work_id", "year", F.explode(F.array(F.struct(F.lit(True).alias("sure"), keys(near, author, place).alias("k")), F.struct(F.lit(False).alias("sure"), keys(both).alias("k")))).alias("x"), "t2")
    keyed = of_work.select("work_id", "year", "x.sure", F.when(~F.col("x.sure"), F.hash("t2")).alias("next"), F.explode("x.k").alias("key"))

    raw = F.coalesce("raw", F.lit(""))
    whole = F.regexp_replace(raw, r"(?<=\p{L})[-‐]\s+(?=\p{L})", "")
    r = cut(refs.withColumns({"t": words(raw), "more": F.when(whole != raw, words(whole))}).withColumn("t", F.array_distinct(F.when(F.col("more").isNull(), F.col("t")).otherwise(F.concat("t", "more")))).drop("more"), "asked")
    y = F.col("ref_year").cast("bigint")
    d = r.select("h1", "h2", "ref_year", matches(raw, r"\d+").alias("d"))
    place = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, 2), lambda z: key(F.lit("place"), x, z))))
    each = r.select("h1", "h2", "ref_year", family("first_author").alias("a"), F.explode("t").alias("x"))
    alone = F.when(y.isNotNull() & F.lit(near_only), key(F.lit("none"), "x")).otherwise(key(F.lit("any"), "x"))
    each = each.select("h1", "h2", "ref_year", F.explode(F.array(alone, F.when(y.isNotNull(), key(F.lit("year"), "x", y)), F.when(F.col("a").isNotNull(), key(F.lit("author"), "a", "x")))).alias("key"))
    said = each.where("key is not null").unionByName(d.select("h1", "h2", "ref_year", F.explode(F.array_distinct(place)).alias("key")))
    met = said.join(keyed, "key")
    if near_only:
        met = met.where(~_far("year", "ref_year"))
    met = met.groupBy("h1", "h2", "work_id").agg(F.max("sure").alias("sure"), F.max("next").alias("next"))
    # Titles move to the texts, which are longer.
    pairs = met.join(titled.select("work_id", "title", "year", "family"), "work_id").join(r, ["h1", "h2"])
    return pairs.where(F.col("sure") | F.exists("t", lambda x: F.hash(x) == F.col("next"))).select("h1", "h2", "raw", "first_author", "ref_year", "work_id", "title", "year", "family")


def _far(a: str, b: str) -> Column:
    """Whether two years, both known, are more than one apart."""
    return F.coalesce(F.abs(F.col(a).cast("bigint") - F.col(b)) > 1, F.lit(False))


def best_candidate(pairs: DataFrame, key: str | list[str]) -> DataFrame:
    """key, work_id, confidence: of candidate pairs (raw, title, ref_year, year, first_author, family) the best.

    Partial ratio of the title in the raw text, less 0.3 if the years are more than one apart and 0.15
    if the authors differ; accepted from 0.8, at most 0.94. Ties go to the smaller work_id.

    A pair is compared only as far as it may be accepted and reach the best of the same key: titles that stand in the text
    as they are come first, and a penalty raises what the ratio must be.
    """
    keys = [key] if isinstance(key, str) else key
    less = F.when(_far("year", "ref_year"), 0.3).otherwise(0.0) + F.when((F.coalesce("first_author", F.lit("")) != "") & (F.coalesce("family", F.lit("")) != "") & (F.lower("first_author") != F.lower("family")), 0.15).otherwise(0.0)
    rows = pairs.withColumn("less", less).where("less <= 0.2").withColumns({"t": F.lower("title"), "r": F.lower("raw")}).where("t <> '' and r <> ''")
    rows = rows.withColumn("whole", F.contains("r", "t") | F.contains("t", "r"))
    rows = rows.withColumn("least", F.greatest(F.lit(0.8), F.max(F.when(F.col("whole"), 1 - F.col("less"))).over(Window.partitionBy(*keys))))
    rows = rows.where("whole or least + less < 1")
    ratio = partial_ratio_best_udf("t", "r", "whole", "least", "less", F.xxhash64(*keys))
    scored = rows.withColumn("s", F.round(ratio - F.col("less"), 6)).groupBy(*keys).agg(F.max(F.struct("s", (-F.col("work_id")).alias("w"))).alias("b"))
    return scored.select(*keys, (-F.col("b.w")).alias("work_id"), F.least(F.col("b.s"), F.lit(0.94)).alias("confidence")).where("confidence >= 0.8")


def best_candidates(refs: DataFrame, works: DataFrame) -> DataFrame:
    """ref_id, work_id, confidence: best_candidate of candidate_pairs, each text compared once however many refs have it."""
    asked, r = _alike(refs.where("ref_id is not null"))
    best = best_candidate(_met(r, works, near_only=True), ["h1", "h2"])
    each = asked.join(best, ["h1", "h2"]).groupBy("ref_id").agg(F.max(F.struct("confidence", (-F.col("work_id")).alias("w"))).alias("b"))
    return each.select("ref_id", (-F.col("b.w")).alias("work_id"), F.col("b.confidence").alias("confidence"))


def text_supports(rows: DataFrame) -> DataFrame:
    """Adds support (0..1) and verified: how far a record (title, family, year, doi) agrees with a page (page, pdf_title, guessed_title)."""
    best = F.greatest(title_similarity_udf("title", "pdf_title"), title_similarity_udf("title", "guessed_title"))
    page = F.lower(F.coalesce("page", F.lit("")))
    has = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") & F.contains(page, F.lower(F.col(c).cast("string")))
    part = partial_ratio_udf("title", "page")
    score = F.when(best >= 0.9, 0.5).when((F.coalesce("title", F.lit("")) != "") & (part >= 0.9), 0.45).when(best >= 0.7, 0.25).otherwise(0.0)
    score = score + F.when(has("family"), 0.2).otherwise(0.0) + F.when(has("year"), 0.15).otherwise(0.0) + F.when(has("doi"), 0.15).otherwise(0.0)
    return rows.withColumn("support", F.round(F.least(score, F.lit(1.0)), 6)).withColumn("verified", F.col("support") >= 0.5)
