"""Streams of runs and changes on list state with event-time timers.

Rows of a key wait in a list until the watermark has passed them, and are then worked through in the
order of time; what goes on from them (an open run, the last state) is a value of its own.  A timer
stands at the earliest row that waits, or at the time at which what is open ends by itself; so
a run ends, and a state is forgotten, by the watermark alone, without another row of its key.  The
state is kept by the store of the session, which has to be RocksDB (``use_rocksdb``), in the query's checkpoint
folder: a query that is started again goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that list state and timers need, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class InOrder(StatefulProcessor):
    """Rows (t in microseconds, v) of a key in the order of time, once the watermark has passed them.

    Subclasses say what a row does (``step``) and what time alone does (``rest``); ``carried`` is a tuple or None.
    """

    held_schema = "t long, v double"
    carried_schema = "t long"
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.carried = handle.getValueState("carried", self.carried_schema)

    def step(self, carried: tuple | None, t: int, v) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def rest(self, carried: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        return carried, []

    def wakes(self, carried: tuple | None) -> int | None:
        """The time in microseconds at which ``rest`` has something to do."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            self.held.appendList([(int(t), v) for t, v in zip(b["t"].tolist(), b["v"].tolist(), strict=True)])
        yield self._worked(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._worked(key, timerValues.getCurrentWatermarkInMs())

    def _worked(self, key, watermark_ms: int) -> pd.DataFrame:
        now = watermark_ms * 1000
        rows = sorted(self.held.get(), key=lambda r: r[0]) if self.held.exists() else []
        carried = self.carried.get() if self.carried.exists() else None
        out: list[tuple] = []
        ripe = [r for r in rows if r[0] <= now]
        for t, v in ripe:
            carried, new = self.rest(carried, t)
            out += new
            carried, new = self.step(carried, t, v)
            out += new
        left = rows[len(ripe) :]
        carried, new = self.rest(carried, now)
        out += new
        if ripe:
            if left:
                self.held.put(left)
            else:
                self.held.clear()
        if carried is None:
            self.carried.clear()
        else:
            self.carried.update(carried)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        next_ = [x for x in (left[0][0] if left else None, self.wakes(carried)) if x is not None]
        if next_:
            self.handle.registerTimer(max(min(next_) // 1000 + 1, watermark_ms + 1))
        return pd.DataFrame([(*key, *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


class Runs(InOrder):
    """Runs of consecutive rows at or above a threshold; a run also ends ``gap`` microseconds after its last row."""

    carried_schema = "start long, stop long, n long, best double"
    columns = ["key", "start", "stop", "n", "best"]

    def __init__(self, threshold: float, gap: int) -> None:
        self.threshold, self.gap = threshold, gap

    def step(self, run, t, v):
        if v is None or v != v or v < self.threshold:
            return None, [] if run is None else [tuple(run)]
        return ((t, t, 1, float(v)) if run is None else (run[0], t, run[2] + 1, max(run[3], float(v)))), []

    def rest(self, run, now):
        return (None, [tuple(run)]) if run is not None and now > run[1] + self.gap else (run, [])

    def wakes(self, run):
        return None if run is None else run[1] + self.gap


class Changes(InOrder):
    """Changes of a state; a state that had no row for ``forget`` microseconds is unknown again."""

    held_schema = "t long, v string"
    carried_schema = "state string, t long"
    columns = ["key", "t", "state", "before"]

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def step(self, last, t, v):
        return (v, t), [] if last is not None and last[0] == v else [(t, v, None if last is None else last[0])]

    def rest(self, last, now):
        return (None, []) if last is not None and now > last[1] + self.forget else (last, [])

    def wakes(self, last):
        return None if last is None else last[1] + self.forget


def _rows(stream: DataFrame, value: str, kind: str, late: str, time: str, key: str) -> DataFrame:
    t = F.col(time).cast("timestamp")
    return stream.withColumn("_t", t).withWatermark("_t", late).select(F.col(key).alias("key"), "_t", F.unix_micros("_t").alias("t"), F.col(value).cast(kind).alias("v"))


def threshold_runs(stream: DataFrame, value: str, threshold: float, late: str, gap: int, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, stop, n, best), times in microseconds: runs of consecutive rows at or above a threshold, as soon as the
    watermark has passed a row below it, or ``gap`` microseconds without a row."""
    kind = stream.schema[key].dataType.simpleString()
    out = f"key {kind}, start long, stop long, n long, best double"
    return _rows(stream, value, "double", late, time, key).groupBy("key").transformWithStateInPandas(Runs(threshold, gap), outputStructType=out, outputMode="Append", timeMode="EventTime")


def changes(stream: DataFrame, state: str, late: str, forget: int, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, t, state, before), t in microseconds: every change of a state in the order of time; before is null for the first
    state, and for one that comes more than ``forget`` microseconds after the last row."""
    kind = stream.schema[key].dataType.simpleString()
    out = f"key {kind}, t long, state string, before string"
    return _rows(stream, state, "string", late, time, key).groupBy("key").transformWithStateInPandas(Changes(forget), outputStructType=out, outputMode="Append", timeMode="EventTime")
