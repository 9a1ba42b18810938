"""Keyed state with event-time timers: capped bursts and the life of sessions.

Both keep a key's events until the watermark has passed them and then replay them in order of time, so a result
doesn't depend on how events were dealt to batches; events behind the watermark are dropped by Spark and change
nothing. State goes when a key has nothing pending, or when its session has expired. The state store must be RocksDB,
which `with_timers` asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURSTS = "key string, start timestamp, fired timestamp, n long"
STATES = "key string, state string, at timestamp"


def _times(values: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(values, unit="us"), dtype="datetime64[us]")


def bursts_of(times: list[int], quiet: int, cap: int) -> list[tuple[int, int, int]]:
    """(first, fire time, events) of the bursts of sorted times: one fires `quiet` after its last event, `cap` after its first at the latest; an event at that very time opens the next."""
    out: list[tuple[int, int, int]] = []
    for t in times:
        if out and t < out[-1][1]:
            first, _, n = out[-1]
            out[-1] = (first, min(t + quiet, first + cap), n + 1)
        else:
            out.append((t, t + min(quiet, cap), 1))
    return out


class Debounce(StatefulProcessor):
    """Emits a burst when the watermark passes its fire time."""

    def __init__(self, quiet: int, cap: int) -> None:
        self.quiet, self.cap = quiet, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long")

    def _settle(self, key, times: list[int], watermark: int) -> Iterator[pd.DataFrame]:
        found = bursts_of(sorted(times), self.quiet, self.cap)
        ripe = [b for b in found if b[1] <= watermark]
        # A burst is closed once the watermark has reached its fire time: no event before that can come any more.
        left = [t for t in times if not ripe or t >= ripe[-1][1]]
        if left:
            self.pending.put([(t,) for t in left])
            self.handle.registerTimer(-(-found[len(ripe)][1] // 1000))
        else:
            self.pending.clear()
        if ripe:
            yield pd.DataFrame({"key": [key[0]] * len(ripe), "start": _times([b[0] for b in ripe]), "fired": _times([b[1] for b in ripe]), "n": [b[2] for b in ripe]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [int(t[0]) for t in self.pending.get()] if self.pending.exists() else []
        for part in rows:
            times += part["us"].tolist()
        yield from self._settle(key, times, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            yield from self._settle(key, [int(t[0]) for t in self.pending.get()], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def life(events: list[tuple[int, str]], state: tuple[str, int] | None, stale: int, until: int) -> tuple[list[tuple[str, int]], tuple[str, int] | None]:
    """Changes of one session by sorted (time, kind), kind being `end` or anything else, and its state (name, last seen) at `until`.

    It lives from its first event; an end retires it; an event after that, or after it expired, revives it; `stale`
    after its last event a living one expires. A retired one is forgotten after the same time, without a change.
    """
    out: list[tuple[str, int]] = []

    def age(to: int) -> None:
        nonlocal state
        if state and state[1] + stale <= to:
            if state[0] == "live":
                out.append(("expired", state[1] + stale))
            state = ("gone", state[1]) if state[0] == "live" else state

    for t, kind in events:
        age(t)
        was = state[0] if state else None
        if kind == "end":
            if was == "live":
                out.append(("retired", t))
            state = ("retired", t) if was else None
        else:
            if was != "live":
                out.append(("revived" if was else "live", t))
            state = ("live", t)
    age(until)
    return out, state


class Liveness(StatefulProcessor):
    """Emits a session's changes once the watermark has passed them."""

    def __init__(self, stale: int, keep: int) -> None:
        self.stale, self.keep = stale, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, kind string")
        self.state = handle.getValueState("state", "name string, seen long")

    def _settle(self, key, events: list[tuple[int, str]], watermark: int) -> Iterator[pd.DataFrame]:
        events.sort()
        state = tuple(self.state.get()) if self.state.exists() else None
        ripe, left = [e for e in events if e[0] < watermark], [e for e in events if e[0] >= watermark]
        changes, state = life(ripe, state, self.stale, watermark)
        timers = []
        if left:
            self.pending.put(left)
            timers.append(left[0][0] + 1000)
        else:
            self.pending.clear()
        if state and (state[0] == "live" or state[1] + self.keep > watermark or left):
            self.state.update(state)
            timers.append(state[1] + (self.stale if state[0] == "live" else self.keep))
        else:
            self.state.clear()
        for t in timers:
            self.handle.registerTimer(max(-(-t // 1000), watermark // 1000 + 1))
        if changes:
            yield pd.DataFrame({"key": [key[0]] * len(changes), "state": [c[0] for c in changes], "at": _times([c[1] for c in changes])})

    def _waiting(self) -> list[tuple[int, str]]:
        return [(int(e[0]), e[1]) for e in self.pending.get()] if self.pending.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = self._waiting()
        for part in rows:
            events += list(zip(part["us"].tolist(), part["kind"].tolist(), strict=True))
        yield from self._settle(key, events, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._waiting(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def with_timers(events: DataFrame, key: str, time: str, late: str, processor: StatefulProcessor, out: str, *columns: str) -> DataFrame:
    """A stream of the processor's rows; the session's state store becomes RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("us"), *columns)
    return rows.groupBy("key").transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def capped_bursts(events: DataFrame, time: str, root: str, quiet_s: float = 2, cap_s: float = 10, late: str = "10 seconds") -> DataFrame:
    """BURSTS of a stream: bursts of each root, fired after a quiet period, or a cap after their first event."""
    return with_timers(events, root, time, late, Debounce(int(quiet_s * 1e6), int(cap_s * 1e6)), BURSTS)


def session_states(events: DataFrame, time: str, session: str, kind: str, stale_s: float, late: str = "1 minute", keep_s: float = 30 * 86400) -> DataFrame:
    """STATES of a stream of session events: live, retired, revived, expired; a session that isn't live is remembered for `keep`."""
    return with_timers(events, session, time, late, Liveness(int(stale_s * 1e6), int(keep_s * 1e6)), STATES, F.col(kind).cast("string").alias("kind"))
