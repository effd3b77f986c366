"""Streaming operators with ends that need no next event: state by entries, and timers in event time.

A timer fires when the watermark has passed it, whether its key has had news or not, so silent scopes and districts
end in time. State is kept by entries that are written when they change, in RocksDB; ``timed`` sets that provider for
queries that start within it. Rows of a batch are taken in time order; what ends before a row is told before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tocsin.operators.correlate import DECISION, EVENT, PLACE, Correlator, decisions_frame, plain_events
from tocsin.operators.risk import LEVELS as LEVEL_NAMES
from tocsin.plans.settings import Settings

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which timers need."""
    had = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if had is None else spark.conf.set(PROVIDER, had)


def next_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """The key's only timer from now on; None: none."""
    held = list(handle.listTimers())
    for t in held:
        if t != at_ms:
            handle.deleteTimer(t)
    if at_ms is not None and at_ms not in held:
        handle.registerTimer(at_ms)


def passed(timer_values, expired) -> int:
    """The time up to which a timer's key has its ends told: the watermark, as an end that follows another one gets no timer before it, and maybe no batch after it."""
    return max(expired.getExpiryTimeInMs(), timer_values.getCurrentWatermarkInMs())


def ends_until(c: Correlator, now: int) -> Iterator[dict]:
    """The ends up to a second, each at its time."""
    while (end := c.next_end()) is not None and end <= now:
        yield from c.ended(end)


_PLACE = pa.struct([("lat", pa.float64()), ("lng", pa.float64()), ("name", pa.string())])
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), PLACE: _PLACE}
#: EVENT in Arrow's types.
ARROW_EVENT = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ", 1) for f in re.split(r", (?![^<]*>)", EVENT))])
#: Decisions that are made at once, and events that are plain values at once.
SOME = 1000


class Ordered:
    """Rows of EVENT in time order: all of a batch are held as columns, a tenth of what they take as plain values, and few are taken out at once."""

    def __init__(self, frames: Iterable[pd.DataFrame]):
        self.rows = pa.concat_tables(pa.Table.from_pylist(plain_events(f), ARROW_EVENT) for f in frames).combine_chunks()
        self.order = pc.sort_indices(self.rows, [("timestamp", "ascending"), ("event_id", "ascending")])
        self.newest = pc.max(self.rows["timestamp"]).as_py()

    def __iter__(self) -> Iterator[dict]:
        for k in range(0, len(self.order), SOME):
            yield from self.rows.take(self.order[k : k + SOME]).to_pylist()


class Resting:
    """Impacts beyond the active window, which only a reply or a link can reach: fetched when asked for."""

    def __init__(self, incidents, replies):
        self.incidents, self.replies, self.fetched = incidents, replies, {}

    def reply(self, message: str) -> str | None:
        return self.replies.getValue((message,))[0] if self.replies.containsKey((message,)) else None

    def incident(self, of: str) -> tuple[dict, list[str]] | None:
        if not self.incidents.containsKey((of,)):
            return None
        self.fetched[of] = self.incidents.getValue((of,))[0]
        return tuple(json.loads(self.fetched[of]))


class Correlating(StatefulProcessor):
    """The correlator of a scope: an entry for each incident, written when it changes; its first end is its timer."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "id string", "entry string")
        self.resting = handle.getMapState("resting", "id string", "entry string")
        self.replies = handle.getMapState("replies", "message string", "id string")
        self.channels = handle.getMapState("channels", "channel string", "id string, at bigint")
        self.told = handle.getValueState("told", "n bigint")

    def _run(self, key: tuple, work, newest: int) -> Iterator[pd.DataFrame]:
        """Decisions by some, of which one lot is held; the state is written when all are made."""
        raw = {k[0]: v[0] for k, v in self.live.iterator()}
        entries = {k: json.loads(v) for k, v in raw.items()}
        channels = {k[0]: (v[0], int(v[1])) for k, v in self.channels.iterator()}
        rest = Resting(self.resting, self.replies)
        c = Correlator(self.settings, {k: i for k, (i, _) in entries.items()}, dict(channels), {m: k for k, (_, messages) in entries.items() for m in messages}, rest)
        decisions, told = iter(work(c)), int(self.told.get()[0]) if self.told.exists() else 0
        while out := list(islice(decisions, SOME)):
            yield decisions_frame(key[0], out, told)
            told += len(out)
        self.told.update((told,))
        for name, of in c.channels.items():
            if channels.get(name) != of:
                self.channels.updateValue((name,), of)
        for name in channels.keys() - c.channels.keys():
            self.channels.removeKey((name,))
        for k in (raw.keys() | rest.fetched.keys()) - c.incidents.keys():
            self._forget(k, raw, rest)
        for k, i in c.incidents.items():
            entry = json.dumps([i, c.messages_of(k)])
            rests = i["status"] == "impact" and not self.settings.impact_ttl and i["last_updated_at"] < newest - self.settings.active_window
            if rests and rest.fetched.get(k) != entry:
                self._forget(k, raw, rest)
                self.resting.updateValue((k,), (entry,))
                for m in c.messages_of(k):
                    self.replies.updateValue((m,), (k,))
            elif not rests and raw.get(k) != entry:
                self._forget(k, {}, rest)
                self.live.updateValue((k,), (entry,))
        end = c.next_end()
        next_timer(self.handle, None if end is None else end * 1000)

    def _forget(self, k: str, raw: dict, rest: Resting) -> None:
        if k in raw:
            self.live.removeKey((k,))
        if k in rest.fetched:
            for m in json.loads(rest.fetched[k])[1]:
                if rest.reply(m) == k:
                    self.replies.removeKey((m,))
            self.resting.removeKey((k,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = Ordered(rows)
        yield from self._run(key, lambda c: c.run(held), held.newest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = passed(timerValues, expiredTimerInfo) // 1000
        yield from self._run(key, lambda c: ends_until(c, now), now)

    def close(self) -> None:
        pass


def correlated(events: DataFrame, settings: Settings = Settings(), late: str = "10 minutes") -> DataFrame:
    """The correlator's decisions over a stream of EVENT rows, with expiries at their time; rows later than ``late`` are not taken."""
    marked = events.withColumn("_ts", F.timestamp_seconds("timestamp")).withWatermark("_ts", late)
    return marked.groupBy("scope").transformWithStateInPandas(Correlating(settings), DECISION, "Append", "EventTime")


EXPIRED = "id string, at_ms bigint"


class Expiring(StatefulProcessor):
    """One incident's last update; its end is the first second in which it has been silent for too long."""

    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], int(self.last.get()[0]) if self.last.exists() else None
        for at in sorted(int(a) for f in rows for a in f["at"]):
            if last is not None and at - last > self.stale_after:
                out.append((key[0], (last + self.stale_after + 1) * 1000))
            last = at if last is None else max(at, last)
        self.last.update((last,))
        next_timer(self.handle, (last + self.stale_after + 1) * 1000)
        yield pd.DataFrame(out, columns=["id", "at_ms"]).astype({"at_ms": "int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs())], columns=["id", "at_ms"])

    def close(self) -> None:
        pass


def expiries(updates: DataFrame, settings: Settings = Settings(), late: str = "10 minutes") -> DataFrame:
    """(id, at_ms) of every time that an incident has had no update (id, at) for longer than ``stale_after`` seconds."""
    marked = updates.select("id", "at", F.timestamp_seconds("at").alias("_ts")).withWatermark("_ts", late)
    return marked.groupBy("id").transformWithStateInPandas(Expiring(settings.stale_after), EXPIRED, "Append", "EventTime")


CHANGED = "id string, at_ms bigint, rank int, level string"
_STATE = "raw int, override int, until bigint, prev int, ended bigint, rank int, level string"


class Clocked:
    """A district by the clock: its threat lasts from tick to tick, its override and its cool-down end at their time."""

    def __init__(self, settings: Settings, raw: int = 0, override: int = 0, until: int = 0, prev: int = 0, ended: int = -1, rank: int = 0, level: str | None = None):
        self.s, self.raw, self.override, self.until, self.prev, self.ended, self.rank, self.level = settings, raw, override, until, prev, ended, rank, level

    def state(self) -> tuple:
        return self.raw, self.override, self.until, self.prev, self.ended, self.rank, self.level

    def next_end(self) -> int | None:
        ends = [self.until] if self.override else []
        if self.level == "green":
            ends.append(self.ended + self.s.cooldown_ms)
        return min(ends, default=None)

    def _look(self, at: int) -> Iterator[tuple[int, int, str | None]]:
        rank = max(self.raw, self.override)
        if rank:
            self.ended = -1
        elif self.prev:
            self.ended = at
        self.prev = rank
        level = LEVEL_NAMES.get(rank, "green" if self.ended >= 0 and at - self.ended < self.s.cooldown_ms else None)
        if (rank, level) != (self.rank, self.level):
            self.rank, self.level = rank, level
            yield at, rank, level

    def until_time(self, at: int) -> Iterator[tuple[int, int, str | None]]:
        """Changes of ends up to a time."""
        while (end := self.next_end()) is not None and end <= at:
            if self.override and self.until <= end:
                self.override = 0
            if end < at:
                yield from self._look(end)
            elif not self.override:
                return

    def apply(self, at: int, rows: list[tuple[str, int]]) -> Iterator[tuple[int, int, str | None]]:
        """Changes up to a time, and by what comes at it: resets, marks and ticks (kind, rank)."""
        yield from self.until_time(at)
        for kind, rank in sorted(rows, key=lambda x: (("reset", "mark", "tick").index(x[0]), x[1])):
            if kind == "reset":
                self.raw, self.override, self.until, self.prev, self.ended = 0, 0, 0, 0, -1
            elif kind == "mark":
                self.override, self.until = max(rank, self.override), at + self.s.override_ms
            else:
                self.raw = rank
        yield from self._look(at)


class Levelling(StatefulProcessor):
    """A district's state, with a timer at the next end of its override or cool-down."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", _STATE)

    def _changes(self, key: tuple, times: dict[int, list[tuple[str, int]]], now: int = -1) -> pd.DataFrame:
        d = Clocked(self.settings, *(self.held.get() if self.held.exists() else ()))
        out = [(key[0], *change) for at in sorted(times) for change in d.apply(at, times[at])]
        while (end := d.next_end()) is not None and end <= now:
            out += ((key[0], *change) for change in d.apply(end, []))
        self.held.update(d.state())
        next_timer(self.handle, d.next_end())
        return pd.DataFrame(out, columns=["id", "at_ms", "rank", "level"]).astype({"at_ms": "int64", "rank": "int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times: dict[int, list[tuple[str, int]]] = {}
        for f in rows:
            for at, kind, rank in zip(f["at_ms"].tolist(), f["kind"], f["rank"].fillna(0).astype(int).tolist(), strict=True):
                times.setdefault(at, []).append((kind, rank))
        yield self._changes(key, times)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._changes(key, {}, passed(timerValues, expiredTimerInfo))

    def close(self) -> None:
        pass


def level_changes(rows: DataFrame, settings: Settings = Settings(), late: str = "10 minutes") -> DataFrame:
    """Each change (id, at_ms, rank, level) of a district's level, over rows (id, at_ms, kind, rank), at its time.

    Ticks say what threat there is from then on, marks override it for a while, a reset forgets all. Of several ticks
    at one time the highest counts.
    """
    marked = rows.select("id", "at_ms", "kind", "rank", F.timestamp_millis("at_ms").alias("_ts")).withWatermark("_ts", late)
    return marked.groupBy("id").transformWithStateInPandas(Levelling(settings), CHANGED, "Append", "EventTime")
