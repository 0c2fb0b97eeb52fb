"""Folds over late and shuffled streams (T1, T21): rows wait in a keyed buffer until the watermark has passed them, then go through in order.

A key's rows are put into state under their time; an event-time timer at that time
fires once the watermark is beyond it, when no earlier row can come any more. What
is released goes through the same step as the batch fold. A second timer forgets a
key whose state can no longer matter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quirespark.operators.health import CEILING, breaker_step

MS = 1000  # microseconds


class OrderedFold(StatefulProcessor):
    """``step(state, row values)`` over a key's rows in the order of (us, tie), each once the watermark has passed it.

    ``state`` and the waiting rows are kept as JSON. ``forget(state, us)`` is the
    time in microseconds from which a state equals none, so that it can go.
    """

    def __init__(self, key: str, inputs: list[str], tie: str, start: Callable[[], Any], step: Callable, forget: Callable[[Any, int], int | None]):
        self.key, self.inputs, self.tie = key, inputs, tie
        self.start, self.step, self.forget = start, step, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")
        self.held = handle.getValueState("held", "state string, us long, expires long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, list] = {}
        mark = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            # a row of a millisecond is due when the watermark is beyond it, at the next one
            new.setdefault(max(r.us // MS + 1, mark + 1), []).append([r.us, r[self.tie], *(r[c] for c in self.inputs)])
        for ms, found in new.items():
            there = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), (json.dumps(there + found),))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        held = self.held.get() if self.held.exists() else None
        state, last, expires = (json.loads(held[0]), held[1], held[2]) if held else (None, None, None)
        if self.waiting.containsKey((ms,)):
            rows = sorted(json.loads(self.waiting.getValue((ms,))[0]), key=lambda r: (r[0], r[1]))
            self.waiting.removeKey((ms,))
            state = self.start() if state is None else state
            for us, tie, *values in rows:
                state, made = self.step(state, *values)
                last = us
                yield Row(**{self.key: key[0]}, us=us, tie=tie, **made)
            until = self.forget(state, last)
            if expires:
                self.handle.deleteTimer(expires)
            expires = None if until is None else max(until // MS + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self.held.update((json.dumps(state), last, expires or 0))
            if expires:
                self.handle.registerTimer(expires)
        elif expires == ms:
            self.held.clear()

    def close(self) -> None:
        pass


def ordered(
    events: DataFrame, key: str, at: str, tie: str, inputs: list[str], start: Callable[[], Any], step: Callable, out: dict[str, str], forget: Callable[[Any, int], int | None], late: str
) -> DataFrame:
    """(key, us, tie, outputs) of a fold over a stream whose rows come in any order within ``late``.

    ``at`` is a timestamp, ``us`` its microseconds as a column of the stream;
    ``step`` returns the state and a dict of outputs. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). A row that comes when the watermark has passed it is due at once.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    schema = StructType().add(key, kinds[key]).add("us", "long").add("tie", kinds[tie])
    for name, kind in out.items():
        schema = schema.add(name, kind)
    fold = OrderedFold(key, inputs, tie, start, step, forget)
    found = events.withWatermark(at, late).groupBy(key).transformWithState(fold, schema, "Append", "EventTime")
    return found.withColumnRenamed("tie", tie)


def breaker(events: DataFrame, key: str, at: str = "at", tie: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The circuit breaker's state after each event (key, us, event_id, failed, account), as the batch fold has it.

    A closed breaker is forgotten at once, any other once it has long ceased to block.
    """

    def step(state, us, failed, account):
        held, (name, consecutive, until) = breaker_step(tuple(state) if state else (), us, failed, account)
        return list(held), {"state": name, "consecutive": consecutive, "blocked_until": until}

    def forget(state, us):
        # a count of failures lives on however long nothing comes, so only a closed breaker equals none
        return us if state == [0, 0, False, 0] else max(us, state[3]) + CEILING if not state[0] and not state[1] else None

    out = {"state": "string", "consecutive": "long", "blocked_until": "long"}
    return ordered(events, key, at, tie, ["us", "failed", "account"], list, step, out, forget, late)


def upgrades(events: DataFrame, key: str, at: str = "at", tie: str = "event_id", gap_us: int = 2 * 3600 * 1_000_000, late: str = "1 hour") -> DataFrame:
    """What becomes of a paid upgrade: a hold opens with an ``open`` event, ``paid`` completes it, two hours without either cancel it.

    (key, us, event_id, session, outcome): ``session`` counts holds, ``outcome`` is
    opened, kept, completed, expired or ignored; an event that finds its hold too old says expired and, if it opens, begins the next.
    """

    def step(state, us, kind):
        return upgrade_step(state, us, kind, gap_us)

    return ordered(events, key, at, tie, ["us", "kind"], lambda: [0, None], step, {"session": "long", "outcome": "string"}, lambda state, us: None, late)


def upgrade_step(state, us: int, kind: str, gap_us: int):
    """One event of :func:`upgrades`: (number of holds, when the open one was last touched)."""
    n, since = state
    expired = since is not None and us - since > gap_us
    if expired:
        since = None
    if kind == "open":
        outcome = "expired" if expired else "opened" if since is None else "kept"
        n, since = n + (since is None), us
    elif kind == "paid" and since is not None:
        outcome, since = "completed", None
    else:
        outcome = "expired" if expired else "ignored"
    return [n, since], {"session": n, "outcome": outcome}
