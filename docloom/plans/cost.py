"""Cost and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import cost
from docloom.operators.index import chunk_rows
from docloom.plans.base import query
from docloom.session import table


@query("SELECT event_type, n, round(CASE WHEN n >= 3 THEN 0.7 * m + 0.3 * 0.5 ELSE 0.5 END, 6) AS per_unit FROM (SELECT event_type, count(*) AS n, quantile_cont(round(value, 4), 0.5) AS m FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 0) WHERE r <= 50 GROUP BY event_type)")
def timings_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Events stand in for timing samples: the type for the stage, the value for seconds a unit."""
    return cost.per_unit(table(spark, folder, "events"), "event_type", "value", ["ts", "event_id"])


_COST_SQL = (
    "SELECT doc_id, round(CASE kind WHEN 'pdf' THEN 0.44::DOUBLE * p + 0.3::DOUBLE WHEN 'scan' THEN 2.8 WHEN 'office' THEN 0.4::DOUBLE * p1 + 6.0 WHEN 'html' THEN 6.3 WHEN 'text' THEN 0.1 WHEN 'markdown' THEN 0.1 ELSE 0.0 END, 1) AS seconds, "
    "CAST(CASE kind WHEN 'pdf' THEN 700 WHEN 'scan' THEN 300 WHEN 'office' THEN 900 WHEN 'html' THEN 900 WHEN 'text' THEN 50 WHEN 'markdown' THEN 50 ELSE 0 END AS DOUBLE) AS peak_mb, "
    "CAST(CASE kind WHEN 'pdf' THEN p WHEN 'scan' THEN 1 WHEN 'office' THEN p1 WHEN 'html' THEN 1 WHEN 'text' THEN 1 WHEN 'markdown' THEN 1 ELSE 0 END AS INTEGER) AS units "
    "FROM (SELECT doc_id, kind, CASE WHEN coalesce(pages, 0) > 0 THEN pages ELSE greatest(1, CAST(floor(coalesce(n_chars, 0) * 40 / 60000) AS INTEGER)) END AS p, greatest(1, coalesce(pages, 1)) AS p1 FROM documents)"
)


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an invented file size."""
    return table(spark, folder, "documents").select("doc_id", "kind", "pages", (F.coalesce("n_chars", F.lit(0)) * 40).alias("size_bytes"), F.lit(0).alias("ocr_pages"))


@query(_COST_SQL)
def estimate_cost(spark: SparkSession, folder: str) -> DataFrame:
    return cost.estimate(_sized(spark, folder))


@query(f"SELECT d.kind, count(*) AS docs, round(sum(e.seconds), 1) AS seconds, max(e.peak_mb) AS peak_mb FROM ({_COST_SQL}) e JOIN documents d USING (doc_id) GROUP BY d.kind")
def reprocess_plan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _sized(spark, folder)
    return docs.select("doc_id", "kind").join(cost.estimate(docs), "doc_id").groupBy("kind").agg(F.count("*").alias("docs"), F.round(F.sum("seconds"), 1).alias("seconds"), F.max("peak_mb").alias("peak_mb"))


@query(
    "WITH c AS (SELECT doc_id, idx, any_value(text) AS text FROM chunks WHERE doc_id IS NOT NULL AND idx IS NOT NULL GROUP BY doc_id, idx), s AS (SELECT doc_id, count(*) AS n, sum(length(text)) AS total FROM c GROUP BY doc_id), "
    "k AS (SELECT *, CAST(CASE WHEN total <= 2000 THEN n ELSE least(n, greatest(4, floor(n * 2000 / total))) END AS BIGINT) AS keep FROM s), w AS (SELECT DISTINCT doc_id, CAST(floor(i * n / keep) AS BIGINT) AS place FROM (SELECT *, unnest(range(0, keep)) AS i FROM k)), "
    "p AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS place FROM c) SELECT doc_id, idx, place FROM p JOIN w USING (doc_id, place)"
)
def sample_even(spark: SparkSession, folder: str) -> DataFrame:
    return cost.sample_even(chunk_rows(table(spark, folder, "chunks")).select("doc_id", "idx", "text"), 2000)


@query("SELECT doc_id, unnest(list_slice(range(0, n, greatest(1, n // least(4, n))), 1, 4)) AS page FROM (SELECT doc_id, greatest(coalesce(pages, 1), 1) AS n FROM documents)")
def sample_pages(spark: SparkSession, folder: str) -> DataFrame:
    return cost.sample_pages(table(spark, folder, "documents"))


@query("SELECT doc_id, least(b, CAST(floor(b / n * k * 0.4 * n / k) AS BIGINT)) AS estimated_bytes, round(0.08 * n * 1.15 + 0.5, 1) AS estimated_seconds FROM (SELECT doc_id, CAST(coalesce(n_chars, 0) * 40 AS BIGINT) AS b, CAST(greatest(coalesce(pages, 1), 1) AS DOUBLE) AS n, CAST(least(4, greatest(coalesce(pages, 1), 1)) AS DOUBLE) AS k FROM documents)")
def compress_preview(spark: SparkSession, folder: str) -> DataFrame:
    return cost.compress_preview(_sized(spark, folder), F.lit(0.4))
