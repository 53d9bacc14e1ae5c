"""Operators with a state a key, on Spark's own state over RocksDB: transformWithState, and applyInPandasWithState where no timer is needed.

A processor gets a key's rows of one trigger, folds them in order of (time, id) and keeps
what later rows need; an event-time timer drops the state once the watermark has passed
the time from which it decides nothing.  Spark versions the state with the checkpoint, so a
trigger that runs again starts from the state before it.  Of a key's rows a task holds time
and id only, and a trigger reads about ``jobs.TRIGGER_BYTES`` at most, so a key with a third
of all rows is bounded by the trigger and not by the table.

Defined cases: a null key is a key; rows with equal time go by id; rows without a time are
left out, as are rows that the watermark has passed.
"""

from __future__ import annotations

import contextlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that transformWithState needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
Fold = Callable[[list[float], list[float]], tuple[list[bool], list[float]]]


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """STORE for the streams that start inside; the session has its settings back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def accept_ttl(seconds: float) -> Fold:
    """Accept a time unless one was accepted in the last `seconds`, these included; what is rejected does not refresh."""

    def fold(times, recent):
        taken, at = [False] * len(times), 0
        while at < len(times):
            if recent:
                at = bisect_right(times, recent[-1] + seconds, at)
            if at < len(times):
                taken[at], recent = True, [times[at]]
                at += 1
        return taken, recent

    return fold


def accept_rate(limit: int, seconds: float) -> Fold:
    """Accept while fewer than `limit` were accepted in the last `seconds`."""

    def fold(times, recent):
        taken, recent, at = [False] * len(times), list(recent), 0
        while at < len(times):
            recent = recent[-limit:] if limit else []
            if len(recent) == limit:  # nothing more before the oldest one leaves the window
                at = bisect_left(times, recent[0] + seconds, at) if limit else len(times)
            if at < len(times):
                taken[at] = True
                recent.append(times[at])
                at += 1
        last = times[-1] if times else None
        return taken, [x for x in recent if last is None or x > last - seconds][-limit:] if limit else []

    return fold


def state_key(*columns: str) -> Column:
    """Columns as one text that is never null: the state's Python side takes a null number for another key."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def content_key(content: Column) -> Column:
    """url: and the lower-cased trimmed URL, or hash: and 16 hex digits of a text's SHA-256; null for null."""
    url = content.startswith("http://") | content.startswith("https://")
    return F.when(url, F.concat(F.lit("url:"), F.lower(F.trim(content)))).otherwise(F.concat(F.lit("hash:"), F.substring(F.sha2(content, 256), 1, 16)))


class Accepting(StatefulProcessor):
    """Accepts or rejects a key's rows; its state is the list of accepted times that still count."""

    def __init__(self, fold: Fold, seconds: float):
        self.fold, self.seconds = fold, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", T.StructType([T.StructField("t", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat([r[["key", "t", "id"]] for r in rows], ignore_index=True).sort_values(["t", "id"], kind="stable")
        taken, recent = self.fold(own["t"].tolist(), [r[0] for r in self.recent.get()])
        self.recent.put([(x,) for x in recent])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if recent:
            self.handle.registerTimer(int((recent[-1] + self.seconds) * 1000) + 1)
        yield pd.DataFrame({"key": own["key"], "id": own["id"], "accepted": taken})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def accepted(stream: DataFrame, key: Column, row_id: Column, time: str, fold: Fold, seconds: float) -> DataFrame:
    """key, id, accepted of the rows of a stream with a watermark on the column `time`; run it inside rocksdb()."""
    rows = stream.where(F.col(time).isNotNull()).select(key.alias("key"), row_id.alias("id"), F.col(time), F.col(time).cast("double").alias("t"))
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField("key", kinds["key"]), T.StructField("id", kinds["id"]), T.StructField("accepted", T.BooleanType())])
    return rows.withColumn("state_key", state_key("key")).groupBy("state_key").transformWithStateInPandas(Accepting(fold, seconds), out, "Append", "EventTime")


def clamp_steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running sum of a key's steps, clamped to [-1, 1] at each; its state is the sum and the number of steps."""
    own = pd.concat(list(batches), ignore_index=True)
    order = np.lexsort((own["id"].to_numpy(), own["t"].to_numpy()))
    x, n = state.get if state.exists else (0.0, 0)
    for step in own["step"].to_numpy()[order].tolist():
        x = min(1.0, max(-1.0, x + step))
    state.update((x, n + len(own)))
    yield own[["user_id", "dim"]].head(1).assign(x=x, n=n + len(own))


def clamped(stream: DataFrame, time: str) -> DataFrame:
    """user_id, dim, x, n of the keys that a trigger touched, from columns user_id, dim, id, step and `time`.

    The state comes and goes with a key's rows, many keys a batch, as a key is cheap to fold and
    needs no timer; a processor would ask for it over a socket, three times a key.
    """
    rows = stream.where(F.col(time).isNotNull()).select("user_id", "dim", "id", "step", F.col(time).cast("double").alias("t"))
    keyed = rows.withColumn("state_key", state_key("user_id", "dim")).groupBy("state_key")
    return keyed.applyInPandasWithState(clamp_steps, "user_id long, dim string, x double, n long", "x double, n long", "update", GroupStateTimeout.NoTimeout)
