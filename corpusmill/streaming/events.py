"""Commands and lifecycle events as streams.

Deduplication comes in two forms: by event time with a watermark, whose state is bounded by the watermark and partitioned by
command; and by a window of the latest ids per group, which forgets as a service with a bounded memory does.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators import control

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RETRIES, FIRST_WAIT, LONGEST_WAIT = 5, 0.1, 5.0
JITTER = 0.1


def deduplicated(commands: DataFrame, key: str = "command_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key within delay of event time."""
    return commands.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


class Fifo(StatefulProcessor):
    """Emits rows whose id isn't among the latest size accepted ids of the group."""

    def __init__(self, size: int = control.WINDOW, key: str = "command_id"):
        self.size, self.key = size, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "place long")
        self.order = handle.getMapState("order", "place long", "id string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        for batch in rows:
            fresh = []
            for i, name in enumerate(batch[self.key]):
                if self.seen.containsKey((name,)):
                    continue
                self.seen.updateValue((name,), (following,))
                self.order.updateValue((following,), (name,))
                following += 1
                fresh.append(i)
                while following - first > self.size:
                    oldest = self.order.getValue((first,))[0]
                    self.order.removeKey((first,))
                    self.seen.removeKey((oldest,))
                    first += 1
            if fresh:
                yield batch.iloc[fresh]
        self.ends.update((first, following))

    def close(self) -> None:
        pass


def fifo_dedup(commands: DataFrame, group: str, size: int = control.WINDOW, key: str = "command_id") -> DataFrame:
    """Rows of commands not among the latest size ids of their group. A constant group is one window, in one task.

    The session needs STATE_STORE.
    """
    return commands.groupBy(group).transformWithStateInPandas(Fifo(size, key), commands.schema, "Append", "None")


def lifecycle(commands: DataFrame) -> DataFrame:
    """Events of commands with a known action: the step of the dataset is in progress."""
    return control.mapped(commands).filter("step is not null").select("command_id", "dataset_id", F.col("step").alias("step"), control.wire_state(F.lit("IN_PROGRESS")).alias("state"), "ts")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """key, begins, ends, events of each session (an extension of our own; the control plane has no windows)."""
    own = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("events"))
    return own.select(key, F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "events")


def sound(raw: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows with decoded frames; malformed ones are dropped, and counted as a metric of the stream."""
    tried = raw.withColumn("decoded", control.frames.decoded(F.col(frame)))
    return tried.observe("frames", F.count(F.lit(1)).alias("read"), F.count_if(F.col("decoded").isNull()).alias("malformed")).filter("decoded is not null")


class Latest(StatefulProcessor):
    """Keeps each key's state of the greatest order, and emits it when it changes; null when it expires.

    A state expires so many milliseconds after its event time, by a timer; one that has changed since waits for its own.
    """

    def __init__(self, keys: list[str], orders: int, expiry: int | None):
        self.keys, self.orders, self.expiry = keys, [f"o{i}" for i in range(orders)], expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", ", ".join(["state string, at long", *(f"{o} long" for o in self.orders)]))

    def _kept(self, top: tuple | None, batch: pd.DataFrame) -> tuple | None:
        for row in zip(batch["state"], batch["at"], *(batch[o] for o in self.orders), strict=True):
            if top is None or row[2:] >= top[2:]:
                top = (row[0], *map(int, row[1:]))
        return top

    def _put(self, top: tuple) -> None:
        self.latest.update(top)
        if self.expiry is not None:
            self.handle.registerTimer(top[1] + self.expiry)

    def _row(self, key: tuple, state: str | None) -> pd.DataFrame:
        return pd.DataFrame([(*key, state)], columns=[*self.keys, "state"])

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        if (top := self._kept(self.latest.get() if self.latest.exists() else None, initial)) is not None:
            self._put(top)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = top = self.latest.get() if self.latest.exists() else None
        for batch in rows:
            top = self._kept(top, batch)
        if top is not None and top != before:
            self._put(top)
            yield self._row(key, top[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[1] + self.expiry <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield self._row(key, None)

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, keys: list[str], state: str, order: list[str], at: str | None, unknown: str = "IDLE") -> DataFrame:
    """keys, state, at (milliseconds), o0, ...: the order's columns as whole numbers; rows without any of these are left out."""
    types = dict(rows.dtypes)
    whole = lambda c: F.unix_micros(F.col(c)) if types[c] == "timestamp" else F.col(c).cast("long")
    rows = rows.dropna(subset=[*order, *([at] if at else [])])
    return rows.select(*keys, F.coalesce(F.col(state).cast("string"), F.lit(unknown)).alias("state"), (F.unix_millis(F.col(at)) if at else F.lit(0).cast("long")).alias("at"), *(whole(c).alias(f"o{i}") for i, c in enumerate(order)), *([F.col(at).alias("_time")] if at else []))


def kept_states(stream: DataFrame, keys: list[str], state: str, order: list[str], at: str | None = None, expiry: int | None = None, delay: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """keys, state as they change: the state of the row with the greatest order (times or whole numbers).

    With at (an event time) and expiry (milliseconds) states that old are forgotten, delay behind the latest event. initial has
    the states to begin with, rows like the stream's. The state survives in the checkpoint, where states() reads it; the session
    needs STATE_STORE.
    """
    if (at is None) != (expiry is None):
        raise ValueError("expiry and at go together")
    own = _ordered(stream.withWatermark(at, delay) if at else stream, keys, state, order, at)
    first = None if initial is None else _ordered(initial, keys, state, order, at).groupBy(*keys)
    schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("state", T.StringType())])
    return own.groupBy(*keys).transformWithStateInPandas(Latest(keys, len(order), expiry), schema, "Update", "EventTime" if at else "None", first)


def states(spark, checkpoint: str, keys: list[str]) -> DataFrame:
    """keys, state: what a stream of kept_states() knows, read from the state that its checkpoint holds."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load().select(*(F.col(f"key.{k}").alias(k) for k in keys), "value.state")


class Permanent(Exception):
    """A delivery that must not be tried again."""


def relayed(stream: DataFrame, deliver: Callable[[DataFrame, int], None], retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> DataStreamWriter:
    """A writer that hands each batch to deliver, again after a growing pause when it fails, not after Permanent."""

    def each(batch: DataFrame, number: int) -> None:
        for attempt in range(retries + 1):
            try:
                deliver(batch, number)
                return
            except Permanent:
                return
            except Exception:
                if attempt == retries:
                    raise
                wait(min(FIRST_WAIT * 2**attempt, LONGEST_WAIT) * random.uniform(1 - JITTER, 1 + JITTER))

    return stream.writeStream.foreachBatch(each)


def heartbeats(spark, service: str, seconds: int = 15) -> DataFrame:
    """service, at, key: a row every seconds, with a key that a repeat has too."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()
    return ticks.select(F.lit(service).alias("service"), F.col("timestamp").alias("at"), F.concat_ws("/", F.lit(service), F.col("value").cast("string")).alias("key"))
