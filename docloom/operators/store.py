"""Relational operations of the document store, the feeds and the event log.

Point updates become "the last event of a key wins"; deletes become anti-joins; counters are derived,
never kept. Everything that ranks within a key uses max_by/min_by or a window whose rank filter Spark
applies before the shuffle (WindowGroupLimit), so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("pdf", "html", "markdown", "office", "text", "scan", "image", "audio")


def newest(rows: DataFrame, stamp: str, key: str, limit: int, where: Column | None = None) -> DataFrame:
    """Newest rows first with a limit: one top-k, ties by key."""
    kept = rows if where is None else rows.where(where)
    return kept.orderBy(F.desc(stamp), key).limit(limit)


def tags_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tag): tags that every document carries by itself: language, source and kind, nulls left out."""
    made = F.array(F.concat(F.lit("lang:"), F.col("lang")), F.col("source"), F.col("kind"))
    return docs.select("doc_id", F.explode(made).alias("tag")).where("tag is not null")


def with_tags(docs: DataFrame, doc_tags: DataFrame) -> DataFrame:
    """Documents with their sorted tags, an empty list for none."""
    lists = doc_tags.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return docs.join(lists, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tagged(docs: DataFrame, doc_tags: DataFrame, name: str) -> DataFrame:
    """Documents with a tag of that name, blind to case; a semi-join, so no document comes twice."""
    return docs.join(doc_tags.where(F.lower("tag") == name.lower()).select("doc_id"), "doc_id", "left_semi")


def tag_counts(names: DataFrame, doc_tags: DataFrame) -> DataFrame:
    """Every tag name with its number of documents, zero included; counted before the join."""
    n = doc_tags.groupBy("tag").agg(F.count("*").alias("n"))
    return names.join(n, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def orphans(names: DataFrame, doc_tags: DataFrame) -> DataFrame:
    return names.join(doc_tags.select("tag"), "tag", "left_anti")


def dedupe_tags(rows: DataFrame, doc: str, tag: str, place: str) -> DataFrame:
    """The first spelling of each tag of a document, blind to case."""
    return rows.groupBy(doc, F.lower(tag).alias("tag_key")).agg(F.min(F.struct(place, tag)).alias("f")).select(doc, f"f.{place}", f"f.{tag}")


def same_content(docs: DataFrame) -> DataFrame:
    """(sha, doc_id, copies): of each hash, blind to case, the newest document and how many have it."""
    d = docs.where("sha256 is not null").withColumn("sha", F.lower("sha256"))
    return d.groupBy("sha").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"), F.count("*").alias("copies"))


def register(new: DataFrame, known: DataFrame) -> DataFrame:
    """New documents of an accepted kind whose content is not known yet; the first of equal ones."""
    accepted = new.where(F.col("kind").isin(*KINDS)).withColumn("sha", F.lower("sha256"))
    first = accepted.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    fresh = first.join(known.where("sha256 is not null").select(F.lower("sha256").alias("sha")), "sha", "left_anti")
    return fresh.unionByName(accepted.where("sha is null").select("sha", "doc_id"))


def import_counters(rows: DataFrame, by: str) -> DataFrame:
    """total, imported, skipped (content seen before in id order) and errors (no text) by batch."""
    same = F.coalesce(F.lower("sha256"), F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    slim = rows.select(by, "doc_id", same.alias("same"), F.col("text").isNull().alias("bad"))
    first = slim.groupBy("same").agg(F.min("doc_id").alias("f"))  # reduced before the shuffle, unlike a window
    marked = slim.join(first, "same").withColumn("first", F.col("f") == F.col("doc_id"))
    return marked.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~F.col("bad") & F.col("first")).alias("imported"), F.count_if(~F.col("bad") & ~F.col("first")).alias("skipped"), F.count_if("bad").alias("errors"))


def feed_counts(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Each feed with its numbers of entries and of new ones, one aggregate instead of subqueries."""
    n = entries.groupBy("feed_id").agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "new").alias("fresh"))
    return feeds.join(n, "feed_id", "left").select("feed_id", "name", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("fresh", F.lit(0)).alias("fresh"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, as an insert that ignores what is there."""
    plain = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*plain), F.struct(order)).alias("r")).select(*keys, "r.*")


def last_wins(events: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """The last event's values of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("r")).select(key, "r.*")


def coalescing_update(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """column of rows, replaced where updates has a value; allowed for known columns only."""
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    u = updates.groupBy(key).agg(F.max(column).alias("new"))
    return rows.join(u, key, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def within(rows: DataFrame, stamp: str, now: Column, seconds: int) -> DataFrame:
    return rows.where(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(stamp).cast("timestamp")) <= seconds)


def last_n(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n events of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def sessions_alive(sessions: DataFrame, now: Column, idle: int, most: int) -> DataFrame:
    """Sessions (first_seen, last_seen) that are neither idle for too long nor too old."""
    at = F.unix_seconds(now.cast("timestamp"))
    age = at - F.unix_seconds(F.col("first_seen").cast("timestamp"))
    rest = at - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return sessions.where((rest <= idle) & (age <= most))
