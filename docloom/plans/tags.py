"""Tagging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.columns import YEAR
from docloom.operators import tags
from docloom.plans.base import query
from docloom.session import table


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


_LANG_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({_in(ms.split())}))) AS l_{g}" for g, ms in tags.MARKERS.items())
_LANG_TOP = "greatest(" + ", ".join(f"l_{g}" for g in tags.MARKERS) + ")"
_LANG_FIRST = "CASE " + " ".join(f"WHEN l_{g} = top THEN '{g}'" for g in tags.MARKERS) + " END"
LANG_SQL = (
    f"SELECT doc_id, CASE WHEN top >= greatest(3.0, total * 0.01) THEN {_LANG_FIRST} END AS lang FROM (SELECT *, {_LANG_TOP} AS top FROM (SELECT doc_id, len(w) AS total, {_LANG_COUNTS} "
    f"FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(left(coalesce(text, ''), 6000))), '[a-z]+') AS w FROM documents)))"
)


@query(LANG_SQL)
def lang_guess(spark: SparkSession, folder: str) -> DataFrame:
    return tags.language(table(spark, folder, "documents"))


_W = tags.WORD.replace("'", "''")
TERMS_SQL = (
    f"WITH t AS (SELECT doc_id, unnest(w) AS tok, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(left(coalesce(text, ''), 60000), '{_W}') AS w FROM documents WHERE doc_id IS NOT NULL)), "
    f"l AS (SELECT *, strip_accents(lower(trim(tok, '''’-'))) AS low FROM t), k AS (SELECT * FROM l WHERE length(low) >= 3 AND low NOT IN ({_in(tags.STOP)}) AND (regexp_matches(tok, '{tags.ACRONYM}') OR length(low) >= 5)), "
    r"g AS (SELECT doc_id, low, count(*) AS n, min({'small': NOT regexp_matches(left(tok, 1), '\p{Lu}'), 'pos': pos, 'tok': tok}).tok AS term, min(pos) AS place FROM k GROUP BY doc_id, low HAVING count(*) >= 3) "
    "SELECT doc_id, term, n AS \"count\", rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS rank FROM g) WHERE rank <= 6"
)


@query(TERMS_SQL)
def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return tags.top_terms(table(spark, folder, "documents"))


RAKE_SQL = (
    f"WITH p AS (SELECT doc_id, unnest(ps) AS part, unnest(range(0, len(ps))) AS line FROM (SELECT doc_id, string_split(regexp_replace(strip_accents(lower(left(coalesce(text, ''), 60000))), '[^\\p{{L}}\\p{{N}}_'' \\-]+', '|', 'g'), '|') AS ps FROM documents WHERE doc_id IS NOT NULL)), "
    "w AS (SELECT doc_id, line, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (SELECT doc_id, line, regexp_extract_all(part, '[\\p{L}\\p{N}_''\\-]+') AS ws FROM p)), "
    f"s AS (SELECT *, word IN ({_in(tags.STOP)}) OR length(word) < 3 AS stop FROM w), r AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc_id, line ORDER BY pos) AS run FROM s), "
    "z AS (SELECT doc_id, word, count(*) OVER (PARTITION BY doc_id, line, run) AS size FROM r WHERE NOT stop) "
    "SELECT doc_id, word, count(*) AS freq, CAST(sum(size - 1) AS BIGINT) AS degree, round((sum(size - 1) + count(*)) / count(*), 6) AS score FROM z GROUP BY doc_id, word"
)


@query(RAKE_SQL)
def rake_word_scores(spark: SparkSession, folder: str) -> DataFrame:
    return tags.rake_scores(table(spark, folder, "documents"))


@query()
def keyphrases(spark: SparkSession, folder: str) -> DataFrame:
    return tags.keyphrase_rows(table(spark, folder, "documents"))


@query()
def auto_tags(spark: SparkSession, folder: str) -> DataFrame:
    return tags.auto_tags(table(spark, folder, "documents"))


@query(
    f"SELECT doc_id, y AS year FROM (SELECT doc_id, CAST(list_sort(list_transform(list_distinct(ys), lambda y: {{'n': -len(list_filter(ys, lambda x: x = y)), 'place': list_position(ys, y), 'y': y}}))[1].y AS INTEGER) AS y FROM (SELECT doc_id, regexp_extract_all(coalesce(title, '') || chr(10) || left(coalesce(text, ''), 4000), '{YEAR}', 1) AS ys FROM documents))"
)
def year_detect(spark: SparkSession, folder: str) -> DataFrame:
    return tags.with_year(table(spark, folder, "documents").select("doc_id", "title", "text")).select("doc_id", "year")
