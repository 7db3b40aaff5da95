"""Cost estimates: stage timings, document estimates, sampling under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds for a unit (page, image, document or minute) and peak MB of each stage (fixed values).
STAGES = {
    "detect": (0.02, 60), "layout": (0.05, 80), "markdown": (0.35, 700), "text": (0.02, 60), "ocr.tesseract": (2.5, 300), "ocr.macocr": (0.6, 250), "ocr.macocr-cli": (0.9, 250),
    "docling.office": (0.4, 900), "docling.html": (0.3, 900), "docling.audio": (6.0, 2500), "docling.image": (3.0, 1500), "compress.pymupdf": (0.08, 200), "compress.ghostscript": (0.5, 300), "embed": (0.03, 900),
}
UNKNOWN, IMPORT_SECONDS = (0.5, 300), 6.0


def per_unit(samples: DataFrame, stage: str, value: str, order: list[str]) -> DataFrame:
    """stage, n, per_unit: 0.7 x median of the last 50 samples + 0.3 x the constant, from three samples on; else the constant.

    The rank filter runs before the shuffle (WindowGroupLimit), so a stage with a third of all samples
    sends fifty rows a task.
    """
    w = Window.partitionBy(stage).orderBy(*[F.desc(o) for o in order])
    last = samples.where(F.col(value) > 0).withColumn("r", F.row_number().over(w)).where("r <= 50")
    base: Column = F.lit(UNKNOWN[0])
    for name, (seconds, _) in STAGES.items():
        base = F.when(F.col(stage) == name, seconds).otherwise(base)
    return last.groupBy(stage).agg(F.count("*").alias("n"), F.percentile(F.round(value, 4), 0.5).alias("m")).select(stage, "n", F.round(F.when(F.col("n") >= 3, 0.7 * F.col("m") + 0.3 * base).otherwise(base), 6).alias("per_unit"))


def estimate(docs: DataFrame, ocr: str = "auto", backend: str = "tesseract", apple: bool = False) -> DataFrame:
    """doc_id, seconds, peak_mb, units of processing documents (kind, pages, size_bytes, ocr_pages)."""
    pages = F.when(F.coalesce("pages", F.lit(0)) > 0, F.col("pages")).otherwise(F.greatest(F.lit(1), F.floor(F.col("size_bytes") / 60_000).cast("int")))
    sec, mb = STAGES[f"ocr.{backend}"]
    scanned = F.lit(0) if ocr == "off" else pages if ocr == "force" else F.coalesce("ocr_pages", F.lit(0))
    each = sum(STAGES[s][0] for s in ("detect", "layout", "markdown", "text"))
    one = F.greatest(F.lit(1), F.coalesce("pages", F.lit(1)))
    minutes = F.greatest(F.lit(1.0), F.col("size_bytes") / 1e6)
    audio = STAGES["docling.audio"][0] * (0.2 if apple else 1.0)

    def row(seconds: Column, peak: Column | float, units: Column) -> Column:
        return F.struct(F.round(seconds, 1).alias("seconds"), (peak if isinstance(peak, Column) else F.lit(float(peak))).cast("double").alias("peak_mb"), units.cast("int").alias("units"))

    kind = F.col("kind")
    made = (
        F.when(kind == "pdf", row(each * pages + sec * scanned + 0.3, 700.0, pages))
        .when(kind.isin("image", "scan"), row(F.lit(0.2) if ocr == "off" else F.lit(sec + 0.3), 60.0 if ocr == "off" else float(mb), F.lit(1)))
        .when(kind.isin("audio", "video"), row(audio * minutes + IMPORT_SECONDS, float(STAGES["docling.audio"][1]), minutes))
        .when(kind.isin("office", "epub"), row(STAGES["docling.office"][0] * one + IMPORT_SECONDS, 900.0, one))
        .when(kind == "html", row(F.lit(STAGES["docling.html"][0] + IMPORT_SECONDS), 900.0, F.lit(1)))
        .when(kind.isin("text", "markdown"), row(F.lit(0.1), 50.0, F.lit(1)))
        .otherwise(row(F.lit(0.0), 0.0, F.lit(0)))
    )
    return docs.select("doc_id", made.alias("e")).select("doc_id", "e.seconds", "e.peak_mb", "e.units")


def sample_even(chunks: DataFrame, budget: int) -> DataFrame:
    """doc_id, idx, place: chunks spread evenly so that a document stays near budget characters; all of a short one.

    keep = max(4, n * budget / total) chunks, the i-th being chunk i * n / keep.
    """
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"))
    keep = F.when(F.col("total") <= budget, F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(4), F.floor(F.col("n") * budget / F.col("total")))))
    wanted = sizes.withColumn("keep", keep.cast("bigint")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("keep") - 1)))
    wanted = wanted.select("doc_id", F.floor(F.col("i") * F.col("n") / F.col("keep")).cast("bigint").alias("place")).distinct()
    placed = chunks.select("doc_id", "idx").withColumn("place", (F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1).cast("bigint"))
    return placed.join(wanted, ["doc_id", "place"]).select("doc_id", "idx", "place")


def sample_pages(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, page (from 0): every max(1, n / k)-th page, the first k of them."""
    n = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))
    step = F.greatest(F.lit(1), F.floor(n / F.least(F.lit(k), n)).cast("int"))
    return docs.select("doc_id", F.explode(F.slice(F.sequence(F.lit(0), n - 1, step), 1, k)).alias("page"))


def compress_preview(docs: DataFrame, ratio: Column, k: int = 4) -> DataFrame:
    """doc_id, estimated_bytes, estimated_seconds: a sample's size and time (bytes x ratio) carried on to all pages, never above the original."""
    n = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))
    took = F.least(F.lit(k), n)
    sample = F.col("size_bytes") / n * took * ratio
    size = F.least(F.col("size_bytes"), F.floor(sample * n / took).cast("bigint"))
    return docs.select("doc_id", size.alias("estimated_bytes"), F.round(STAGES["compress.pymupdf"][0] * took / took * n * 1.15 + 0.5, 1).alias("estimated_seconds"))


