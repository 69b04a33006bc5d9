"""Streaming forms of binning and segmentation; late rows are dropped by the watermark."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_counts(stream: DataFrame, width: str, late: str, time: str = "ts", series: str = "event_type") -> DataFrame:
    """(series_id, start, n) of each window; empty windows cannot be emitted by a stream."""
    return (stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), F.col(series).alias("series_id"))
            .agg(F.count("*").alias("n")).select("series_id", F.col("w.start").alias("start"), "n"))


def sessions(stream: DataFrame, gap: str, late: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, stop, n) of runs with gaps up to ``gap`` (an exact gap continues the run)."""
    return (stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(key, F.session_window("_t", gap).alias("w"))
            .agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"))


def sliding_counts(stream: DataFrame, width: str, slide: str, late: str, time: str = "ts", series: str = "event_type") -> DataFrame:
    """(series_id, start, n) of windows that overlap; complete ones only, as the watermark passes them."""
    return (stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width, slide).alias("w"), F.col(series).alias("series_id"))
            .agg(F.count("*").alias("n")).select("series_id", F.col("w.start").alias("start"), "n"))


def running_moments(stream: DataFrame, value: str = "value", key: str = "event_type") -> DataFrame:
    """(series_id, n, mean, std) of all rows so far, in update mode; std is that of the population, 0 counts as 1."""
    x = F.col(value).cast("double")
    g = stream.groupBy(F.col(key).alias("series_id")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("_s"))
    return g.select("series_id", "n", "mean", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")).alias("std"))


def last_values(stream: DataFrame, value: str = "value", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, t, value) of the latest row of each key so far, in update mode; of equal times the greatest value."""
    last = F.max(F.struct(F.col(time).cast("timestamp").alias("t"), F.col(value).alias("v")))
    return stream.groupBy(F.col(key).alias("key")).agg(last.alias("m")).select("key", "m.t", F.col("m.v").alias("value"))


def _ordered(batches, held: list) -> list:
    rows = list(held)
    for b in batches:
        rows += list(zip(b["t"].astype("int64").tolist(), b["v"].tolist(), strict=True))
    return sorted(rows)


def changes(stream: DataFrame, state: str, late: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, t, state, before) of every change of a state, in the order of time; t in microseconds.

    Rows wait until the watermark has passed them, so rows that come in another order are put right.
    """
    def step(group, batches, st):
        held, last = ([], None) if not st.exists else _unpacked(st.get)
        now = st.getCurrentWatermarkMs() * 1000
        rows = _ordered(batches, held)
        ripe, rest, out = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now], []
        for t, v in ripe:
            if v != last:
                out.append((group[0], t, v, last))
                last = v
        _kept(st, rest, last, now)
        yield pd.DataFrame(out, columns=["key", "t", "state", "before"])

    return _stateful(stream, state, "string", late, time, key, step, "key {kind}, t long, state string, before string")


def threshold_runs(stream: DataFrame, value: str, threshold: float, late: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, stop, n, best) of runs of consecutive rows at or above a threshold, once they have ended; t in microseconds."""
    def step(group, batches, st):
        held, run = ([], None) if not st.exists else _unpacked(st.get)
        now = st.getCurrentWatermarkMs() * 1000
        rows = _ordered(batches, held)
        ripe, rest, out = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now], []
        for t, v in ripe:
            if v >= threshold:
                run = [t, t, 1, v] if run is None else [run[0], t, run[2] + 1, max(run[3], v)]
            elif run is not None:
                out.append((group[0], *run))
                run = None
        _kept(st, rest, run, now)
        yield pd.DataFrame(out, columns=["key", "start", "stop", "n", "best"])

    return _stateful(stream, value, "double", late, time, key, step, "key {kind}, start long, stop long, n long, best double")


def _unpacked(state: tuple) -> tuple[list, object]:
    rows, carried = json.loads(state[0])
    return [tuple(r) for r in rows], carried


def _kept(st, rest: list, carried, now: int) -> None:
    st.update((json.dumps([rest, carried]),))
    if rest:
        st.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, now // 1000 + 1))


def _stateful(stream: DataFrame, value: str, kind: str, late: str, time: str, key: str, step, out: str) -> DataFrame:
    """Rows of each key with a state; a key is called again when the watermark passes the rows that it holds."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).select(F.col(key).alias("key"), "_t", F.unix_micros("_t").alias("t"), F.col(value).cast(kind).alias("v"))
    of = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, out.format(kind=of), "held string", "append", "EventTimeTimeout")
