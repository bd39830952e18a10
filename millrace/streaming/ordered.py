"""Folds over a key's events in order of event time, as a stream with keyed state and timers and as a batch, from one definition.

A ``Fold`` says what an event does to a key's state and what comes out. ``in_order`` runs it over a stream whose events come out of order: a key's events wait in a list
state until the watermark has passed them, then the state steps through them by time; a timer at the earliest waiting event wakes the key. A state may
also change by itself at a time it names (a lease that ends), for which another timer stands. ``folded`` runs the same fold over a table, so
both give the same rows for all events up to the watermark. Events later than the watermark when they come are left out, as in any operator with a watermark; it
begins at 1970-01-01, so events of that moment or before are too.

State lives in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER`` before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """Steps of a key's state. ``fields``: the event's columns that a step reads; ``out``: what comes out beside key and time; ``state``: a state's fields."""

    fields: tuple[str, ...] = ()
    out = ""
    state = ""

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        """The state after an event at ``at`` (microseconds), and the rows that come out."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the state changes by itself, if it does."""
        return None

    def expire(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []


def _stepped(fold: Fold, state: tuple, events: list[tuple], upto: int | None) -> tuple[tuple, list[tuple]]:
    """The state after events (at, order, fields...) in order, and changes due by ``upto`` (None: none behind the last event); rows with their time."""
    rows: list[tuple] = []

    def expired(state: tuple, now: int) -> tuple:
        while (due := fold.due(state)) is not None and due <= now:
            state, out = fold.expire(state)
            rows.extend((due, *r) for r in out)
        return state

    for at, _, *event in sorted(events, key=lambda e: e[:2]):
        state = expired(state, at)
        state, out = fold.step(state, at, tuple(event))
        rows.extend((at, *r) for r in out)
    return (state if upto is None else expired(state, upto)), rows


class _InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, names: list[str], event: str) -> None:
        self.fold, self.names, self.event = fold, names, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = handle.getListState("waiting", self.event), handle.getValueState("held", self.fold.state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(v) else v for v in r) for part in rows for r in part[["at_micros", "at_order", *self.fold.fields]].itertuples(index=False)]
        if new:
            self.waiting.appendList([(int(r[0]), int(r[1]), *r[2:]) for r in new])
            self._wake(min(int(r[0]) for r in new), timerValues)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # all events of a millisecond that the watermark has passed are here
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = list(self.waiting.get()) if self.waiting.exists() else []
        now, later = [e for e in events if e[0] < passed], [e for e in events if e[0] >= passed]
        state = self.held.get() if self.held.exists() else self.fold.start()
        state, out = _stepped(self.fold, tuple(state), now, passed - 1)
        self.held.update(state)
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
        due = self.fold.due(state)
        if (then := min([e[0] for e in later] + ([] if due is None else [due]), default=None)) is not None:
            self._wake(then, timerValues)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def _wake(self, at: int, timerValues: Any) -> None:
        """A timer at the first whole millisecond behind ``at``, if none to come is earlier."""
        ms = at // 1000 + 1
        if not any(timerValues.getCurrentWatermarkInMs() < t <= ms for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def _kind(rows: DataFrame, name: str) -> str:
    return dict(rows.dtypes)[name]


def in_order(events: DataFrame, key: str, time: str, fold: Fold, late: str = "10 minutes", order: str | None = None) -> DataFrame:
    """The fold over a stream: ``key``, ``at`` and the fold's columns, in append mode. ``late``: how far behind the newest event one may come; ``order``: a number that orders events of one time."""
    names, out = [key, "at", *[c.split()[0] for c in fold.out.split(", ")]], f"`{key}` {_kind(events, key)}, at long, {fold.out}"
    event = "_at long, _order long" + "".join(f", `{f}` {_kind(events, f)}" for f in fold.fields)
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(key, time, F.unix_micros(F.col(time)).alias("at_micros"), (F.coalesce(F.col(order).cast("long"), F.lit(0)) if order else F.lit(0).cast("long")).alias("at_order"), *[f for f in fold.fields if f not in (key, time)])
    return rows.groupBy(key).transformWithStateInPandas(_InOrder(fold, names, event), out, "append", "eventTime")


def folded(events: DataFrame, key: str, time: str, fold: Fold, order: str | None = None, upto: int | None = None) -> DataFrame:
    """The same over a table; ``upto`` (microseconds): events before it count, and what falls due before it.

    Rows are dealt by the key and sorted, and a task steps through its keys one after the other, so no key is held as a whole.
    """
    names, out = [key, "at", *[c.split()[0] for c in fold.out.split(", ")]], f"`{key}` {_kind(events, key)}, at long, {fold.out}"
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), (F.coalesce(F.col(order).cast("long"), F.lit(0)) if order else F.lit(0).cast("long")).alias("_order"), *fold.fields)
    rows = rows.where("_at IS NOT NULL") if upto is None else rows.where(F.col("_at") < upto)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None
        last = None if upto is None else upto - 1
        for part in batches:
            found = []
            for value, each in part.groupby("_key", sort=False):
                if state is None or value != own:
                    if state is not None:
                        found += [(own, *r) for r in _stepped(fold, state, [], last)[1]]
                    own, state = value, fold.start()
                events_ = [tuple(None if pd.isna(v) else v for v in r) for r in each[["_at", "_order", *fold.fields]].itertuples(index=False)]
                state, out_ = _stepped(fold, state, events_, None)
                found += [(own, *r) for r in out_]
            yield pd.DataFrame(found, columns=names)
        if state is not None:
            yield pd.DataFrame([(own, *r) for r in _stepped(fold, state, [], last)[1]], columns=names)

    return rows.repartition("_key").sortWithinPartitions("_key", "_at", "_order").mapInPandas(scan, out)


class LastBefore(Fold):
    """As-of join: for each ``end`` event, the seconds since the last ``begin`` event at or before it; none if there is none."""

    out, state = "seconds double", "begun long"

    def __init__(self, kind: str, begin: str, end: str) -> None:
        self.fields, self.begin, self.end = (kind,), begin, end

    def start(self) -> tuple:
        return (None,)

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        if event[0] == self.begin:
            return (at,), []
        if event[0] == self.end and state[0] is not None:
            return state, [((at - state[0]) / 1e6,)]
        return state, []


class Leases(Fold):
    """A task's way through a queue, a row for each change of its state. A claimed task that isn't returned within ``lease`` seconds is sent again.

    Moves that the state doesn't allow are passed over. ``moves``: state before (None: not there yet) and after, by event.
    """

    out, state = "state string", "state string, until long"

    def __init__(self, kind: str, moves: dict[str, tuple[str | None, str]], lease: float, claimed: str = "processing", back: str = "sent") -> None:
        self.fields, self.moves, self.lease, self.claimed, self.back = (kind,), moves, int(lease * 1e6), claimed, back

    def start(self) -> tuple:
        return (None, None)

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        before, after = self.moves.get(event[0], (object(), None))
        if before != state[0]:
            return state, []
        return (after, at + self.lease if after == self.claimed else None), [(after,)]

    def due(self, state: tuple) -> int | None:
        return state[1]

    def expire(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return (self.back, None), [(self.back,)]


class WordsMet(Fold):
    """A row when the words have come in as many of a conversation's messages as each needs (any of them, or all): the conversation is over."""

    out, state = "reason string", "met map<string,int>, done boolean"

    def __init__(self, text: str, words: dict[str, int], any_word: bool = True) -> None:
        self.fields, self.words, self.any_word = (text,), {w.lower(): n for w, n in words.items()}, any_word

    def start(self) -> tuple:
        return ({}, False)

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        met, done = dict(state[0] or {}), state[1]
        text = (event[0] or "").lower()
        for w in self.words:
            if w in text:
                met[w] = met.get(w, 0) + 1
        full = [w for w, n in self.words.items() if met.get(w, 0) >= n]
        if done or not (full if self.any_word else len(full) == len(self.words)):
            return (met, done), []
        return (met, True), [(", ".join(sorted(full)),)]
