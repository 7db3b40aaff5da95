"""Stateful operators on event streams, each with the batch fold that it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Sliding log: a hit passes while fewer than limit accepted hits lie within the window before it.

    Refused hits don't count, so this is no count over a range frame; the log never exceeds limit.
    """
    out = []
    for t in times:
        held = [h for h in held if t - h <= window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def fold_by_key(rows: DataFrame, key: str, order: str, shape: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Rows (key, order, t, ...) folded key by key in time order, batch by batch.

    The rows of a key pass through one task in order but are never held together: a batch of them and
    the state are in memory, so a key with a third of all rows costs time there and no memory.
    step(frame of one key, state) gives (frame out, state).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[key].to_numpy()
            cuts = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1]), len(k)]
            for i, j in zip(cuts, cuts[1:]):
                if now is None or k[i] != now[0]:
                    now, state = (k[i],), start()
                out, state = step(pdf.iloc[i:j], state)
                yield out

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "t", order).mapInPandas(run, shape)


def rate_limited(events: DataFrame, key: str, stamp: str, limit: int, window: float, order: str = "event_id") -> DataFrame:
    """Batch form: the events with `accepted`; events with a null key are left out."""
    shape = f"{order} bigint, {key} {events.schema[key].dataType.simpleString()}, accepted boolean"

    def step(pdf: pd.DataFrame, held: list[float]) -> tuple[pd.DataFrame, list[float]]:
        ok, held = accept(pdf["t"].tolist(), held, limit, window)
        return pd.DataFrame({order: pdf[order], key: pdf[key], "accepted": ok}), held

    rows = events.select(order, key, (F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6).alias("t"))
    return fold_by_key(rows, key, order, shape, list, step)


def rate_limited_stream(events: DataFrame, key: str, stamp: str, limit: int, window: float, order: str = "event_id") -> DataFrame:
    """Streaming form: state is the log of accepted times of a key, at most limit long."""
    shape = f"{order} bigint, {key} {events.schema[key].dataType.simpleString()}, accepted boolean"

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(chunks)).sort_values(["t", order])
        ok, held = accept(pdf["t"].tolist(), held, limit, window)
        state.update((held,))
        yield pd.DataFrame({order: pdf[order], key: pdf[key], "accepted": ok})

    rows = events.select(order, key, (F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(run, shape, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def throttle(times: list[float], final: list[bool], last: float, finished: bool, gap: float) -> tuple[list[bool], list[str], float, bool]:
    """Progress is told if the gap since the last telling has passed or the stage is done; after the end the status stays done."""
    told, status = [], []
    for t, f in zip(times, final):
        tell = f or t - last >= gap
        if tell:
            last = t
        told.append(tell)
        finished = finished or f
        status.append("done" if finished else "running")
    return told, status, last, finished


def throttled_stream(events: DataFrame, key: str, stamp: str, final: str, gap: float, order: str = "event_id") -> DataFrame:
    """The progress events worth telling, with their status."""
    shape = f"{order} bigint, {key} {events.schema[key].dataType.simpleString()}, status string"

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, finished = state.get if state.exists else (float("-inf"), False)
        pdf = pd.concat(list(chunks)).sort_values(["t", order])
        told, status, last, finished = throttle(pdf["t"].tolist(), pdf["final"].tolist(), last, finished, gap)
        state.update((last, finished))
        yield pd.DataFrame({order: pdf[order], key: pdf[key], "status": status})[told]

    rows = events.select(order, key, (F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6).alias("t"), F.expr(final).alias("final"))
    return rows.groupBy(key).applyInPandasWithState(run, shape, "last double, finished boolean", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, stamp: str, final: str, gap: float, order: str = "event_id") -> DataFrame:
    """Batch form of throttled_stream."""
    shape = f"{order} bigint, {key} {events.schema[key].dataType.simpleString()}, status string"

    def step(pdf: pd.DataFrame, state: tuple[float, bool]) -> tuple[pd.DataFrame, tuple[float, bool]]:
        told, status, last, finished = throttle(pdf["t"].tolist(), pdf["final"].tolist(), *state, gap)
        return pd.DataFrame({order: pdf[order], key: pdf[key], "status": status})[told], (last, finished)

    rows = events.select(order, key, (F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6).alias("t"), F.expr(final).alias("final"))
    return fold_by_key(rows, key, order, shape, lambda: (float("-inf"), False), step)


def settled(seen: list[tuple[str, int, float]], state: dict[str, tuple[int, float]], quiet: float = 2.0) -> list[str]:
    """Files (name, size, time) whose size hasn't changed for the quiet time; state is kept between scans."""
    ready = []
    for name, size, at in seen:
        old = state.get(name)
        if old is None or old[0] != size:
            state[name] = (size, at)
        elif at - old[1] >= quiet:
            ready.append(name)
            del state[name]
    return ready


def coalesced_reruns(requests: DataFrame, key: str, settings: str, order: str) -> DataFrame:
    """However often a document is submitted while it runs, it runs once more, with the last settings."""
    return requests.groupBy(key).agg(F.max_by(settings, order).alias(settings), F.count("*").alias("asked"))


def session_state(events: DataFrame, key: str, stamp: str, idle: str = "30 minutes") -> DataFrame:
    """Sessions by idle gap on a watermarked stream or a batch."""
    return events.groupBy(F.session_window(F.col(stamp), idle).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hourly(events: DataFrame, stamp: str, kind: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours with a watermark: late events beyond it are dropped."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


