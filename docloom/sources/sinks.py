"""Writing results: bundles by year, reports, the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.columns import safe_stem


def bundle_path(doc_id: Column, title: Column, year: Column) -> Column:
    """<year>/<title (id)>: where a document's files go."""
    return F.concat(F.coalesce(year.cast("string"), F.lit("undated")), F.lit("/"), safe_stem(F.coalesce(title, F.lit("document")), 80), F.lit(" ("), F.left(doc_id.cast("string"), F.lit(6)), F.lit(")"))


def publish(docs: DataFrame, path: str) -> None:
    """Documents (doc_id, title, year, text) as files parted by year; writing again replaces the years written."""
    rows = docs.withColumn("bundle", bundle_path(F.col("doc_id"), F.col("title"), F.col("year")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def reports(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Events (ts, event, detail) at the end of the log."""
    events.select("ts", "event", "detail").write.mode("append").parquet(path)
