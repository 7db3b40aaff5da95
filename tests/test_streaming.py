"""Stateful operators: the folds by brute force, and streams against their batch forms."""

import random
from collections import deque

import pytest

from docloom.plans import streams
from docloom.streaming import runs, state


def test_sliding_log_by_brute_force():
    rng = random.Random(2)
    t, times = 0.0, []
    for _ in range(300):
        t += rng.random() * 3
        times.append(t)
    log, want = deque(), []
    for x in times:
        while log and x - log[0] > 10:
            log.popleft()
        want.append(len(log) < 4)
        if want[-1]:
            log.append(x)
    assert state.accept(times, [], 4, 10)[0] == want
    half = state.accept(times[:150], [], 4, 10)
    assert half[0] + state.accept(times[150:], half[1], 4, 10)[0] == want and len(half[1]) <= 4


def test_throttle():
    told, status, _, _ = state.throttle([0, 0.1, 0.2, 0.21, 0.3], [False, False, False, True, False], float("-inf"), False, 0.15)
    assert told == [True, False, True, True, False] and status == ["running"] * 3 + ["done"] * 2


def test_settled():
    s = {}
    assert state.settled([("a", 1, 0.0)], s) == [] and state.settled([("a", 2, 1.0)], s) == []
    assert state.settled([("a", 2, 2.9)], s) == [] and state.settled([("a", 2, 3.0)], s) == ["a"] and not s


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    rows = [(i, f"2024-01-0{1 + i % 9} {i % 24:02d}:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i), "{}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).repartition(3).write.parquet(f"{d}/events.parquet")
    e = [(i, i % 2, None if i % 7 == 0 else f"g{i % 5}") for i in range(40)]
    spark.createDataFrame(e, "entry_id bigint, feed_id bigint, guid string").repartition(4).write.parquet(f"{d}/entries.parquet")
    return str(d)


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_streams_agree_with_batches(spark, folder):
    assert rows(streams.rate_limit_stream(spark, folder)) == rows(streams.rate_limit(spark, folder))
    assert rows(streams.progress_throttle_stream(spark, folder)) == rows(streams.progress_throttle(spark, folder))
    got = {(r.feed_id, r.guid) for r in streams.stream_feed_upserts(spark, folder).collect()}
    assert got == {(i % 2, f"g{i % 5}") for i in range(40) if i % 7} and streams.stream_feed_upserts(spark, folder).count() == len(got)
    assert streams.stream_entries_once(spark, folder).count() == len(got)


def test_upserts_take_a_batch_again(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "x", 4)], "feed_id bigint, guid string, entry_id bigint")
    u = runs.Upserts(spark, a.schema, ["feed_id", "guid"], "entry_id")
    u.add(a, 0)
    u.add(a, 0)
    u.add(spark.createDataFrame([(1, "x", 1), (2, "x", 9)], a.schema), 1)
    assert sorted((r.feed_id, r.entry_id) for r in u.table().collect()) == [(1, 4), (2, 9)]
    u2 = runs.Upserts(spark, a.schema, ["feed_id", "guid"], "entry_id")
    assert u2.table().count() == 0


def test_folds_run_over_batches(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3) if i % 50 else None, float(rng.randrange(2000))) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id int, s double")
    df = df.withColumn("ts", df.s.cast("timestamp"))
    whole = rows_of(state.rate_limited(df, "user_id", "ts", 4, 60.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(state.rate_limited(df, "user_id", "ts", 4, 60.0)) == whole
        assert rows_of(state.throttled(df, "user_id", "ts", "event_id % 40 = 39", 30.0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for u in range(3):
        mine = sorted((s, i) for i, k, s in rows if k == u)
        want += [(ok, i, u) for ok, (_, i) in zip(state.accept([s for s, _ in mine], [], 4, 60.0)[0], mine)]
    assert whole == sorted(want)
    assert state.rate_limited(df.limit(0), "user_id", "ts", 4, 60.0).count() == 0


def rows_of(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
