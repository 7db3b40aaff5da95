"""Scalar functions of document analytics as Catalyst expressions (no Python in the hot path).

Classes are spelled [\\p{L}\\p{N}_] and [ \\t\\r\\n\\f], never \\w and \\s, whose meaning differs between
regex engines.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[ \t\r\n\f]+"
INDEX_TOKEN = r"[\p{L}\p{N}_\-]+"
YEAR = r"(?:^|[^0-9A-Za-z_])(19[5-9][0-9]|20[0-4][0-9])(?:[^0-9A-Za-z_]|$)"


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, GAP, " "))


def preview(text: Column, size: int = 600) -> Column:
    return F.left(collapse(text), F.lit(size))


def title_guess(text: Column) -> Column:
    """The first line of 4 to 200 characters, without leading #, that starts no table, list or image."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda l: F.btrim(F.ltrim(F.btrim(l, F.lit(" \t\f")), F.lit("#")), F.lit(" \t\f")))
    good = F.filter(lines, lambda l: F.length(l).between(4, 200) & ~F.substring(l, 1, 1).isin("|", "-", "*", "!"))
    return F.try_element_at(good, F.lit(1))


def safe_stem(name: Column, limit: int = 120) -> Column:
    """A file name's stem in safe characters."""
    base = F.regexp_replace(name, r"^.*/", "")
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    safe = F.btrim(F.regexp_replace(stem, r"[^A-Za-z0-9._ -]+", "_"), F.lit(" ._"))
    return F.left(F.when(safe == "", F.lit("document")).otherwise(safe), F.lit(limit))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def clean_title(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", ""))


def _plain_letters() -> tuple[str, str]:
    """Latin letters that decompose into one letter and marks, and these letters, both in lower case."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(c) == len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case without the marks of Latin letters, composed or not; stays in the JVM."""
    return F.translate(F.regexp_replace(F.lower(c), "[\\u0300-\\u036f]+", ""), _MARKED, _PLAIN)


def line_template(c: Column) -> Column:
    """Digits masked, marks dropped, folded: lines that differ in numbers and accents only are equal."""
    t = fold(F.regexp_replace(c, r"[0-9]+", "#"))
    return F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}_#]+", " "))


def garbage_ratio(c: Column) -> Column:
    """Share of U+FFFD, private-use and control characters among those that are no white space."""
    solid = F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\x09-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]", "")
    clean = F.regexp_replace(solid, "[\\ufffd\\ue000-\\uf8ff\\x00-\\x1f\\x7f-\\x9f]", "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise((F.length(solid) - F.length(clean)) / F.length(solid))


def human_size(n: Column) -> Column:
    def shown(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))

    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, shown(1, "KB")).when(n < 1024**3, shown(2, "MB")).when(n.isNotNull(), shown(3, "GB"))


def human_when(age: Column, stamp: Column) -> Column:
    """age in seconds; older than a day: the date."""
    return F.when(age < 60, F.lit("just now")).when(age < 3600, F.concat((age / 60).cast("long").cast("string"), F.lit(" min ago"))).when(
        age < 86400, F.concat((age / 3600).cast("long").cast("string"), F.lit(" h ago"))
    ).otherwise(F.date_format(stamp, "dd MMM yyyy"))


def isbn_valid(raw: Column) -> Column:
    """The digits of a valid ISBN-10 or ISBN-13; null if the check digit is wrong."""
    d = F.upper(F.regexp_replace(raw, r"[ \t\r\n\f\-]", ""))
    # Weights 10..1, X as 10 in the last place; weights 1 and 3 in turn.
    ten = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda s, i: s + (11 - i) * F.when(F.substring(d, i, F.lit(1)) == "X", 10).otherwise(F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0))))
    more = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, 1).otherwise(3) * F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0)))
    return F.when(d.rlike(r"^[0-9]{9}[0-9X]$") & (ten % 11 == 0), d).when(d.rlike(r"^[0-9]{13}$") & (more % 10 == 0), d)


DOI = r"10\.[0-9]{4,9}/[^ \t\r\n\f\"'<>()\[\]{}]+"


def normalize_doi(c: Column) -> Column:
    """The DOI in a string, lower case, without trailing marks or a word glued on by extraction."""
    d = F.btrim(c, F.lit(" \t\r\n"))
    url = F.regexp_extract(d, rf"(?i)doi\.org/({DOI})", 1)
    bare = F.regexp_extract(d, rf"(?i)(?:^|[^0-9A-Za-z_])({DOI})", 1)
    d = F.when(url != "", url).when(bare != "", bare).otherwise(d)
    d = F.rtrim(d, F.lit(".,;:)]}>'\""))
    return F.lower(F.regexp_replace(d, r"(?is)\.(?:Received|Accepted|Published|Copyright|Available)(?:[^0-9A-Za-z_].*)?$", ""))


def level_for(strength: Column) -> Column:
    """Compression level of a strength (clamped to 0..100): dpi, quality, label."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), strength.cast("int")))

    def level(dpi: int, quality: int, label: str) -> Column:
        return F.struct(F.lit(dpi).alias("dpi"), F.lit(quality).alias("quality"), F.lit(label).alias("label"))

    return (
        F.when(s >= 85, level(72, 40, "Smallest (72 dpi, screen)")).when(s >= 65, level(110, 55, "Small (110 dpi, e-book)")).when(s >= 40, level(150, 70, "Balanced (150 dpi)"))
        .when(s >= 15, level(220, 82, "Light (220 dpi, print)")).otherwise(level(300, 90, "Lossless-ish (300 dpi, prepress)"))
    )


#: Progress of the stages: where each begins and how far it reaches, in per cent (fixed values).
STAGES = {"detect": (0, 8), "ocr": (8, 34), "layout": (42, 10), "markdown": (52, 34), "text": (86, 4), "docling": (0, 88), "index": (90, 7), "publish": (97, 2)}


def stage_percent(stage: Column, done: Column, total: Column, most: float = 99.0) -> Column:
    """Overall progress; an unknown stage spans everything, a total of 0 counts as finished."""
    base, span = F.lit(0), F.lit(100)
    for name, (b, s) in STAGES.items():
        base = F.when(stage == name, b).otherwise(base)
        span = F.when(stage == name, s).otherwise(span)
    share = F.when(F.coalesce(total, F.lit(0)) == 0, 1.0).otherwise(done / total)
    return F.round(F.least(F.lit(most), base + span * share), 1)


def json_reply(c: Column) -> Column:
    """The JSON object in a reply as text: fenced, bare, or from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?[ \t\r\n\f]*(\{.*?\})[ \t\r\n\f]*```", 1)
    bare = F.btrim(c, F.lit(" \t\r\n"))
    span = F.regexp_extract(c, r"(?s)(\{.*\})", 1)

    def parsed(x: Column) -> Column:
        return F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(parsed(fenced), parsed(bare), parsed(span))


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def first_year(c: Column) -> Column:
    """The first year 1950 to 2049 that stands alone."""
    return found(c, YEAR).cast("int")


def truncated(c: Column, n: int, notice: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(notice))).otherwise(c)


def _tidy(c: Column, limit: int) -> Column:
    bad = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\\\/:*?\"<>|\u0000-\u001f]", ""))
    return F.rtrim(F.left(F.regexp_replace(bad, GAP, " "), F.lit(limit)))


def build_name(authors: Column, year: Column, title: Column, most: int = 90) -> Column:
    """File name "author - year - title" of a work; authors is an array of structs with family."""
    n = F.coalesce(F.size(authors), F.lit(0))
    first, second = F.try_element_at(authors, F.lit(1))["family"], F.try_element_at(authors, F.lit(2))["family"]
    who = F.when(n <= 0, F.lit("Unknown")).when(n == 1, first).when(n == 2, F.concat(first, F.lit(" and "), second)).otherwise(F.concat(first, F.lit(" et al.")))
    name = F.concat(_tidy(who, 60), F.lit(" - "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(" - "), _tidy(title, most))
    tidy = F.rtrim(_tidy(name, 200), F.lit(" ."))
    return F.when(tidy == "", F.lit("document")).otherwise(tidy)


def citation(w: dict[str, Column]) -> Column:
    """One-line citation from columns authors, year, title, journal, volume, issue, pages, doi."""
    def given(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("")) != ""

    n = F.coalesce(F.size(w["authors"]), F.lit(0))
    who = F.concat(F.coalesce(F.try_element_at(w["authors"], F.lit(1))["family"], F.lit("")), F.when(n > 1, F.lit(" et al.")).otherwise(F.lit("")))
    head = F.array_join(F.filter(F.array(who, F.coalesce(w["year"].cast("string"), F.lit("")), F.coalesce(w["title"], F.lit("")), F.coalesce(w["journal"], F.lit(""))), lambda x: x != ""), ". ")
    volume = F.when(given(w["volume"]), F.concat(F.lit(" "), w["volume"], F.when(given(w["issue"]), F.concat(F.lit("("), w["issue"], F.lit(")"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    pages = F.when(given(w["pages"]), F.concat(F.lit(":"), w["pages"])).otherwise(F.lit(""))
    doi = F.when(given(w["doi"]), F.concat(F.lit(". https://doi.org/"), w["doi"])).otherwise(F.lit(""))
    return F.concat(head, volume, pages, doi)


def display_name(name: Column) -> Column:
    base = F.regexp_replace(name, r"^.*/", "")
    safe = F.btrim(F.regexp_replace(base, r"[^\p{L}\p{N}_.\- ()\[\]&,+']+", "_"), F.lit(" ."))
    return F.when(safe == "", F.lit("document")).otherwise(F.left(safe, F.lit(180)))


def clean_tags(text: Column, most: int = 20, length: int = 40) -> Column:
    """Tags typed as one text: parted at comma, semicolon and newline, tidied, the first of each (blind to case) kept."""
    parts = F.filter(F.transform(F.split(text, "[,;\n]"), lambda t: F.rtrim(F.left(collapse(t), F.lit(length)))), lambda t: t != "")
    parts = F.slice(parts, 1, most)
    return F.filter(parts, lambda t, i: F.array_position(F.transform(parts, F.lower), F.lower(t)) == i + 1)
