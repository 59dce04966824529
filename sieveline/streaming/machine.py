"""Sessions of tabs as a state machine with timers, on streams and on tables.

A tab's events are taken in the order of their time. ``start`` begins a session,
``pause`` and ``resume`` hold and go on with it, ``ask`` waits for a confirmation of
an action, ``answer`` gives one, and ``result`` brings the work of a session, which
counts only while that session is the current one and active. A confirmation that
is not answered in time has failed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: how long a confirmation is waited for.
WAIT_MS = 60_000
OUT = "event_id long, tab long, outcome string"


@dataclass
class Machine:
    """State of one tab: sessions so far, whether the current one goes on, and by
    action what waits: event, session and deadline. ``step`` gives outcomes."""

    wait_ms: int = WAIT_MS
    session: int = 0
    state: str = "none"
    waits: dict[int, tuple[int, int, int]] = field(default_factory=dict)

    def expire(self, before_ms: int) -> list[tuple[int, str]]:
        gone = sorted((a for a, w in self.waits.items() if w[2] < before_ms), key=lambda a: self.waits[a][2])
        return [(self.waits.pop(a)[0], "timeout") for a in gone]

    def step(self, kind: str, event_id: int, at_ms: int, action: int, session: int) -> list[tuple[int, str]]:
        out = self.expire(at_ms)
        if kind == "start":
            self.session, self.state = self.session + 1, "active"
        elif kind in ("pause", "resume"):
            was, becomes, said = ("active", "paused", "paused") if kind == "pause" else ("paused", "active", "resumed")
            out.append((event_id, said if self.state == was else "ignored"))
            self.state = becomes if self.state == was else self.state
        elif kind == "result":
            out.append((event_id, "accepted" if self.state == "active" and self.session == session else "late"))
        elif kind == "ask":
            if self.state == "none" or action in self.waits:
                out.append((event_id, "rejected" if self.state == "none" else "duplicate"))
            else:
                self.waits[action] = event_id, self.session, at_ms + self.wait_ms
        elif kind == "answer" and action in self.waits:
            asked, of, _ = self.waits.pop(action)
            out.append((asked, "confirmed" if of == self.session else "stale"))
        return out

    def packed(self) -> tuple:
        return self.session, self.state, *([[w[i] for w in self.waits.values()] for i in range(3)]), list(self.waits)

    @classmethod
    def unpacked(cls, wait_ms: int, row: tuple | None) -> Machine:
        if row is None:
            return cls(wait_ms)
        session, state, asked, of, until, actions = row
        return cls(wait_ms, session, state, dict(zip(actions, zip(asked, of, until, strict=True), strict=True)))


COLUMNS = ("kind", "event_id", "at_ms", "action", "session")


class Tabs(StatefulProcessor):
    """Events wait until the watermark has passed them, so that they are taken in
    order however they came; one timer a tab stands at whatever is next. What comes
    behind the watermark is told as late and changes nothing."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "session long, state string, asked array<long>, of array<long>, until array<long>, actions array<long>")
        self.held = handle.getListState("held", "kind string, event_id long, at_ms long, action long, session long")

    def _told(self, tab: int, out: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"event_id": [e for e, _ in out], "tab": [tab] * len(out), "outcome": pd.Series([o for _, o in out], dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        late, seen = [], timerValues.getCurrentWatermarkInMs()
        fresh = [r for frame in rows for r in frame[list(COLUMNS)].itertuples(index=False, name=None)]
        late = [(r[1], "too late") for r in fresh if r[2] < seen]
        fresh = [r for r in fresh if r[2] >= seen]
        if fresh:
            self.held.appendList([(k, int(e), int(t), int(a), int(s)) for k, e, t, a, s in fresh])
            self.handle.registerTimer(min(int(r[2]) for r in fresh))
        yield from self._told(key[0], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        seen = timerValues.getCurrentWatermarkInMs()
        held = sorted(((tuple(r)) for r in self.held.get()), key=lambda r: (r[2], r[1]))
        machine = Machine.unpacked(self.wait_ms, tuple(self.machine.get()) if self.machine.exists() else None)
        out = []
        for row in (r for r in held if r[2] < seen):
            out += machine.step(*row)
        out += machine.expire(seen)
        rest = [r for r in held if r[2] >= seen]
        self.held.put(rest) if rest else self.held.clear()
        self.machine.update(machine.packed())
        ahead = [r[2] for r in rest] + [w[2] + 1 for w in machine.waits.values()]
        if ahead:
            self.handle.registerTimer(min(ahead))
        yield from self._told(key[0], out)

    def close(self) -> None:
        pass


def outcomes_of_stream(events: DataFrame, wait_ms: int = WAIT_MS, late: str = "1 hour") -> DataFrame:
    """event_id, tab, outcome of a stream of events (tab, kind, event_id, ts, action,
    session). Needs the RocksDB state store."""
    marked = events.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return marked.groupBy("tab").transformWithStateInPandas(Tabs(wait_ms), OUT, "Append", "EventTime")


def outcomes_of_table(events: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """The same of a table, in which all time has passed. A tab's events are sorted
    on disk and read as a stream; of a tab only its machine is kept."""
    order = events.select("tab", "kind", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "action", "session").repartition("tab").sortWithinPartitions("tab", "at_ms", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine, out = None, Machine(wait_ms), []
        for frame in frames:
            for tab, *row in frame[["tab", *COLUMNS]].itertuples(index=False, name=None):
                if tab != now:
                    out += [(e, now, o) for e, o in machine.expire(2**62)]
                    now, machine = tab, Machine(wait_ms)
                out += [(e, tab, o) for e, o in machine.step(*row)]
            yield pd.DataFrame(out, columns=["event_id", "tab", "outcome"])
            out = []
        yield pd.DataFrame([(e, now, o) for e, o in machine.expire(2**62)], columns=["event_id", "tab", "outcome"])

    return order.mapInPandas(run, OUT)
