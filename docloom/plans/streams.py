"""Streaming queries, each drained over the given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.base import query
from docloom.session import table
from docloom.streaming import runs, state

_ENDS = "event_id % 10 = 9"


@query()
def stream_feed_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries taken in by micro-batches, the first of each (feed, guid) staying."""
    rows = runs.stream(spark, folder, "entries", 2).where("guid is not null").select("feed_id", "guid", "entry_id")
    store = runs.Upserts(spark, rows.schema, ["feed_id", "guid"], "entry_id")
    runs.drain_batches(rows, store.add)
    return store.table()


@query()
def stream_entries_once(spark: SparkSession, folder: str) -> DataFrame:
    """The same by keyed state."""
    rows = runs.stream(spark, folder, "entries").where("guid is not null").select("feed_id", "guid")
    return runs.drain(rows.dropDuplicates(["feed_id", "guid"]))


@query()
def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return state.rate_limited(table(spark, folder, "events"), "user_id", "ts", 5, 86_400.0)


@query()
def rate_limit_stream(spark: SparkSession, folder: str) -> DataFrame:
    return runs.drain(state.rate_limited_stream(runs.stream(spark, folder, "events"), "user_id", "ts", 5, 86_400.0))


@query()
def progress_throttle(spark: SparkSession, folder: str) -> DataFrame:
    return state.throttled(table(spark, folder, "events"), "user_id", "ts", _ENDS, 43_200.0)


@query()
def progress_throttle_stream(spark: SparkSession, folder: str) -> DataFrame:
    return runs.drain(state.throttled_stream(runs.stream(spark, folder, "events"), "user_id", "ts", _ENDS, 43_200.0))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hours that the watermark has closed; the last ones stay open."""
    rows = runs.stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = runs.drain(state.hourly(rows, "ts", "event_type"))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM r GROUP BY user_id, k")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = state.session_state(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS asked FROM events GROUP BY user_id")
def rerun_coalesced(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return state.coalesced_reruns(rows, "user_id", "event_type", "o")
