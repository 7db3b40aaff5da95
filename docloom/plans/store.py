"""Store, feed and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.columns import clean_tags, truncated
from docloom.operators import store
from docloom.plans.base import query
from docloom.session import table

TAGS_SQL = "SELECT doc_id, tag FROM (SELECT doc_id, unnest(['lang:' || lang, source, kind]) AS tag FROM documents) WHERE tag IS NOT NULL"
NAMES_SQL = f"SELECT DISTINCT tag FROM ({TAGS_SQL}) UNION SELECT unnest(['archived', 'lang:pt', 'to-read']) AS tag"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    own = store.tags_of(table(spark, folder, "documents")).select("tag").distinct()
    return own.unionByName(spark.createDataFrame([("archived",), ("lang:pt",), ("to-read",)], "tag string"))


@query("SELECT doc_id, title, lang, kind, created_at FROM documents WHERE kind = 'pdf' AND doc_id IN (SELECT doc_id FROM (" + TAGS_SQL + ") WHERE lower(tag) = 'lang:en') ORDER BY created_at DESC, doc_id LIMIT 200")
def doc_list_filtered(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kept = store.tagged(docs.where("kind = 'pdf'").select("doc_id", "title", "lang", "kind", "created_at"), store.tags_of(docs), "LANG:en")
    return store.newest(kept, "created_at", "doc_id", 200)


@query(f"SELECT d.doc_id, coalesce(t.tags, '') AS tags FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list(DISTINCT tag)), '|') AS tags FROM ({TAGS_SQL}) GROUP BY doc_id) t USING (doc_id)")
def docs_with_tags(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return store.with_tags(docs.select("doc_id"), store.tags_of(docs)).select("doc_id", F.array_join("tags", "|").alias("tags"))


@query("SELECT doc_id, title, array_to_string(outputs, ',') AS outputs FROM (SELECT doc_id, title, list_sort(CASE WHEN kind = 'pdf' THEN ['text', 'layout', 'json'] ELSE ['text', 'json'] END) AS outputs FROM documents)")
def doc_public(spark: SparkSession, folder: str) -> DataFrame:
    """The public projection: of the outputs only their sorted names."""
    outputs = F.when(F.col("kind") == "pdf", F.create_map(*[F.lit(x) for k in ("text", "layout", "json") for x in (k, f"{k}.out")])).otherwise(F.create_map(*[F.lit(x) for k in ("text", "json") for x in (k, f"{k}.out")]))
    return table(spark, folder, "documents").select("doc_id", "title", F.array_join(F.array_sort(F.map_keys(outputs)), ",").alias("outputs"))


@query(f"SELECT n.tag, count(t.doc_id) AS n FROM ({NAMES_SQL}) n LEFT JOIN ({TAGS_SQL}) t ON t.tag = n.tag GROUP BY n.tag")
def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.tag_counts(_names(spark, folder), store.tags_of(table(spark, folder, "documents")))


@query(f"SELECT tag FROM ({NAMES_SQL}) WHERE tag NOT IN (SELECT tag FROM ({TAGS_SQL}))")
def tag_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return store.orphans(_names(spark, folder), store.tags_of(table(spark, folder, "documents")))


@query("SELECT key, pos, tag FROM (SELECT key, pos, tag, row_number() OVER (PARTITION BY key, lower(tag) ORDER BY pos) AS r FROM (SELECT key, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM (SELECT key, min(list_concat(tags, collections)) AS tags FROM zotero_items GROUP BY key))) WHERE r = 1")
def tag_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first spelling of each tag of an item."""
    items = table(spark, folder, "zotero_items").groupBy("key").agg(F.min(F.concat("tags", "collections")).alias("tags"))
    rows = items.select("key", F.posexplode("tags").alias("p", "tag")).select("key", (F.col("p") + 1).cast("bigint").alias("pos"), "tag")
    return store.dedupe_tags(rows, "key", "tag", "pos")


@query(r"SELECT entry_id, array_to_string(list_filter(tags, lambda t, i: list_position(list_transform(tags, lambda u: lower(u)), lower(t)) = i), '|') AS tags FROM (SELECT entry_id, list_slice(list_filter(list_transform(regexp_split_to_array(title, '[,;\n]'), lambda t: rtrim(left(trim(regexp_replace(t, '[ \t\r\n\f]+', ' ', 'g')), 40))), lambda t: t <> ''), 1, 20) AS tags FROM entries WHERE title IS NOT NULL)")
def tags_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Typed tags; entry titles stand in for what a user types."""
    return table(spark, folder, "entries").where("title is not null").select("entry_id", F.array_join(clean_tags(F.col("title")), "|").alias("tags"))


@query("SELECT lower(sha256) AS sha, arg_max(doc_id, (created_at, doc_id)) AS doc_id, count(*) AS copies FROM documents WHERE sha256 IS NOT NULL GROUP BY 1")
def doc_dedupe_sha(spark: SparkSession, folder: str) -> DataFrame:
    return store.same_content(table(spark, folder, "documents"))


@query("WITH old AS (SELECT * FROM documents WHERE batch_no < 12), new AS (SELECT * FROM documents WHERE batch_no >= 12) SELECT doc_id FROM (SELECT min(doc_id) AS doc_id, lower(sha256) AS sha FROM new WHERE kind IN ('pdf', 'html', 'markdown', 'office', 'text', 'scan') AND sha256 IS NOT NULL GROUP BY lower(sha256)) WHERE sha NOT IN (SELECT lower(sha256) FROM old WHERE sha256 IS NOT NULL) UNION ALL SELECT doc_id FROM new WHERE sha256 IS NULL AND kind IN ('pdf', 'html', 'markdown', 'office', 'text', 'scan')")
def register_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The later batches taken in on top of the earlier ones."""
    docs = table(spark, folder, "documents").select("doc_id", "sha256", "kind", "batch_no")
    return store.register(docs.where("batch_no >= 12"), docs.where("batch_no < 12")).select("doc_id")


@query("SELECT batch_no, count(*) AS total, count(*) FILTER (WHERE text IS NOT NULL AND f = doc_id) AS imported, count(*) FILTER (WHERE text IS NOT NULL AND f <> doc_id) AS skipped, count(*) FILTER (WHERE text IS NULL) AS errors FROM (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(lower(sha256), CAST(doc_id AS VARCHAR))) AS f FROM documents) GROUP BY batch_no")
def import_counters(spark: SparkSession, folder: str) -> DataFrame:
    return store.import_counters(table(spark, folder, "documents").select("doc_id", "sha256", "text", "batch_no"), "batch_no")


@query("SELECT f.feed_id, f.name, (SELECT count(*) FROM entries e WHERE e.feed_id = f.feed_id) AS entries, (SELECT count(*) FROM entries e WHERE e.feed_id = f.feed_id AND e.status = 'new') AS fresh FROM feeds f")
def feed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.feed_counts(table(spark, folder, "feeds"), table(spark, folder, "entries").select("feed_id", "status"))


@query("SELECT e.entry_id, f.name AS feed, e.title, e.seen_at FROM entries e JOIN feeds f USING (feed_id) WHERE e.status = 'new' ORDER BY e.seen_at DESC NULLS LAST, e.entry_id DESC LIMIT 100")
def entries_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Newest new entries with their feed's name."""
    new = table(spark, folder, "entries").where("status = 'new'").join(table(spark, folder, "feeds").select("feed_id", F.col("name").alias("feed")), "feed_id")
    return new.orderBy(F.desc_nulls_last("seen_at"), F.desc("entry_id")).limit(100).select("entry_id", "feed", "title", "seen_at")


@query("SELECT feed_id, guid, min(entry_id) AS entry_id FROM entries WHERE guid IS NOT NULL GROUP BY feed_id, guid")
def feed_upsert_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return store.first_wins(table(spark, folder, "entries").where("guid is not null").select("feed_id", "guid", "entry_id"), ["feed_id", "guid"], "entry_id")


@query("SELECT doc_id, kind FROM (SELECT * FROM documents ORDER BY created_at DESC, doc_id LIMIT 100) WHERE kind = 'scan'")
def limit_then_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot takes the newest hundred first and filters then."""
    return store.newest(table(spark, folder, "documents").select("doc_id", "kind", "created_at"), "created_at", "doc_id", 100).where("kind = 'scan'").select("doc_id", "kind")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def status_last_event(spark: SparkSession, folder: str) -> DataFrame:
    return store.last_wins(table(spark, folder, "events").withColumn("status", F.col("event_type")), "user_id", ["status", "ts"], ["ts", "event_id"])


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_audit(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 604800")
def cache_latest_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """The cached value of a key: its last put, if no older than seven days at the last event."""
    events = table(spark, folder, "events")
    last = events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "event_type", "r.*")
    now = events.agg(F.max("ts").alias("now"))
    return store.within(last.crossJoin(F.broadcast(now)), "ts", F.col("now"), 604_800).drop("now")  # one row


@query("SELECT user_id, first_use, n FROM (SELECT user_id, min(ts) AS first_use, count(*) AS n FROM events WHERE event_type = 'login' OR event_type = (SELECT min(event_type) FROM events) GROUP BY user_id) WHERE epoch(first_use) - epoch((SELECT min(ts) FROM events)) <= 86400")
def token_single_use(spark: SparkSession, folder: str) -> DataFrame:
    """A token counts at its first use, if that comes within its life; later uses find nothing."""
    events = table(spark, folder, "events")
    kind = events.agg(F.min("event_type").alias("kind"), F.min("ts").alias("issued"))
    used = events.crossJoin(F.broadcast(kind)).where("event_type = 'login' or event_type = kind")  # one row
    first = used.groupBy("user_id").agg(F.min("ts").alias("first_use"), F.count("*").alias("n"), F.min("issued").alias("issued"))
    return store.within(first, "issued", F.col("first_use"), 86_400).select("user_id", "first_use", "n")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hour_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT e.entry_id, coalesce(d.doc_id, NULL) AS doc_id FROM entries e LEFT JOIN (SELECT title, max(doc_id) AS doc_id FROM documents WHERE title IS NOT NULL GROUP BY title) d ON d.title = e.title")
def coalesce_update(spark: SparkSession, folder: str) -> DataFrame:
    """Entries take the id of the document that was imported under their title."""
    docs = table(spark, folder, "documents").where("title is not null").select("title", "doc_id")
    rows = table(spark, folder, "entries").select("entry_id", "title").withColumn("doc_id", F.lit(None).cast("bigint"))
    return store.coalescing_update(rows, docs, "title", "doc_id").select("entry_id", "doc_id")


@query("SELECT event_type, event_id, r FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 200")
def queue_last_200(spark: SparkSession, folder: str) -> DataFrame:
    """A subscriber's queue keeps the last 200 and drops the oldest."""
    return store.last_n(table(spark, folder, "events").select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"], 200).select("event_type", "event_id", "r")


@query("SELECT user_id FROM (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events GROUP BY user_id) WHERE epoch((SELECT max(ts) FROM events)) - epoch(l) <= 43200 AND epoch((SELECT max(ts) FROM events)) - epoch(f) <= 2592000")
def sessions_alive(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    seen = events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    now = events.agg(F.max("ts").alias("now"))
    return store.sessions_alive(seen.crossJoin(F.broadcast(now)), F.col("now"), 43_200, 2_592_000).select("user_id")  # one row


@query("SELECT batch_no, n, updated FROM (SELECT batch_no, count(*) AS n, max(created_at) AS updated, bool_or(text IS NULL) AS failed FROM documents GROUP BY batch_no) WHERE failed OR epoch((SELECT max(created_at) FROM documents)) - epoch(updated) < 3600")
def home_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that are not clean, or were changed within the hour before the last arrival."""
    docs = table(spark, folder, "documents")
    batches = docs.groupBy("batch_no").agg(F.count("*").alias("n"), F.max("created_at").alias("updated"), F.bool_or(F.col("text").isNull()).alias("failed"))
    now = batches.agg(F.max("updated").alias("now"))
    recent = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("updated").cast("timestamp")) < 3600
    return batches.crossJoin(F.broadcast(now)).where(F.col("failed") | recent).select("batch_no", "n", "updated")  # one row


@query("SELECT kind IN ('pdf', 'html', 'markdown', 'office', 'text', 'scan', 'image', 'audio') AS accepted, count(*) AS n FROM documents GROUP BY 1")
def type_gate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(F.col("kind").isin(*store.KINDS).alias("accepted")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CASE WHEN kind = 'markdown' THEN text END, CASE WHEN kind IN ('pdf', 'text') THEN text END, title) AS view FROM documents")
def view_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The view asked for, else text, else what there is."""
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.when(F.col("kind") == "markdown", F.col("text")), F.when(F.col("kind").isin("pdf", "text"), F.col("text")), F.col("title")).alias("view"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '[truncated]' ELSE text END AS text FROM documents")
def text_truncated(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", truncated(F.col("text"), 500).alias("text"))


@query("SELECT feed_id, entry_id FROM (SELECT feed_id, entry_id, row_number() OVER (PARTITION BY feed_id ORDER BY entry_id) AS r FROM entries JOIN feeds USING (feed_id) WHERE auto_stage AND status = 'new') WHERE r <= 50")
def auto_stage(spark: SparkSession, folder: str) -> DataFrame:
    """At most fifty new entries of each feed that stages by itself."""
    new = table(spark, folder, "entries").where("status = 'new'").select("feed_id", "entry_id").join(table(spark, folder, "feeds").where("auto_stage").select("feed_id"), "feed_id", "left_semi")
    return new.withColumn("r", F.row_number().over(Window.partitionBy("feed_id").orderBy("entry_id"))).where("r <= 50").select("feed_id", "entry_id")


@query("SELECT source, 'folder:' || lower(replace(source, ' ', '-')) AS tag, count(*) AS n FROM (SELECT regexp_extract(source, '^[a-z]+:(.*)$', 1) AS source FROM documents WHERE source LIKE '%:%') GROUP BY ALL")
def source_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags by prefix rule from where a document came from."""
    named = table(spark, folder, "documents").where("source like '%:%'").select(F.regexp_extract("source", "^[a-z]+:(.*)$", 1).alias("source"))
    return named.groupBy("source").agg(F.count("*").alias("n")).withColumn("tag", F.concat(F.lit("folder:"), F.lower(F.replace("source", F.lit(" "), F.lit("-")))))


@query("SELECT key, array_to_string(list_transform(collections, lambda c: coalesce(CASE c WHEN 'main' THEN 'Main library' WHEN 'lab-a' THEN 'Laboratory A' END, c)), '|') AS names FROM (SELECT key, min(collections) AS collections FROM zotero_items GROUP BY key)")
def collection_names(spark: SparkSession, folder: str) -> DataFrame:
    """Collection keys as names, the key itself where no name is known."""
    names = F.create_map(*[F.lit(x) for x in ("main", "Main library", "lab-a", "Laboratory A")])
    items = table(spark, folder, "zotero_items").groupBy("key").agg(F.min("collections").alias("c"))
    return items.select("key", F.array_join(F.transform("c", lambda c: F.coalesce(names[c], c)), "|").alias("names"))
