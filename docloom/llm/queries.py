"""The queries of the training-data problems, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, citations, history, levels, mixing, names, scans, splitting, vectors
from docloom.session import table


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    return citations.match(table(spark, folder, "refs"), table(spark, folder, "works"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bare = table(spark, folder, "refs").where("doi is null and pmid is null").select("ref_id")
    return p1_matches(spark, folder).join(bare, "ref_id", "left_semi").select("ref_id", "work_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "chunks")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "chunks")).where("pieces > 1").select("doc_id", "idx").distinct()


#: Batches of the tables (24 small ones) that an ingest takes in; the links are those of one at a time,
#: which costs a Spark driver some 300 queries (README).
TOGETHER = 4


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and entries are histories of their own, each taken in in the order of batches, side by side."""
    with ThreadPoolExecutor(2) as pool:
        docs = pool.submit(lambda: history.link_batches(history.DocumentHistory(spark), table(spark, folder, "documents"), TOGETHER))
        entries = pool.submit(lambda: history.link_batches(history.EntryHistory(spark), table(spark, folder, "entries"), TOGETHER))
        docs, entries = docs.result(), entries.result()
    return docs.select(F.lit("documents").alias("tbl"), "*").unionByName(entries.select(F.lit("entries").alias("tbl"), "*"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_links(spark, folder).select("tbl", "first_id", "dup_id").distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.neighbours(table(spark, folder, "vectors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = p4_neighbours(spark, folder)
    return near.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    return scans.read_pages(table(spark, folder, "chunks"), table(spark, folder, "ocr_results"), table(spark, folder, "documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    marks = p5_pages(spark, folder).select("tbl", "doc_id", "page", F.explode("marks").alias("m"))
    return marks.select("tbl", "doc_id", "page", "m.line_no", "m.kind").distinct()


def p6_names(spark: SparkSession, folder: str) -> DataFrame:
    return names.link(names.stored_spellings(table(spark, folder, "zotero_items"), table(spark, folder, "works"), table(spark, folder, "refs")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(p6_names(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(table(spark, folder, "documents"))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).blocks


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    return levels.grade(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_levels(spark, folder).select("doc_id", "level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


#: What str.strip() takes away, as DuckDB spells it.
_SPACE = " || ".join(f"chr({ord(c)})" for c in splitting.SPACE)
_FINE = "vec IS NOT NULL AND model IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have an exact one: oversized chunks, and nearest vectors by brute force."""
    return {
        "p2_found": f"SELECT DISTINCT doc_id, idx FROM chunks WHERE length(trim(text, {_SPACE})) > 2200",
        "p4_found": (
            f"WITH v AS (SELECT DISTINCT vec_id, model, dim, CAST(vec AS DOUBLE[]) AS x FROM vectors WHERE {_FINE}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.x, b.x), 10) DESC, b.vec_id) AS r "
            "FROM v a JOIN v b ON a.model = b.model AND a.dim = b.dim AND a.vec_id <> b.vec_id) SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM p WHERE r <= 5"
        ),
    }
