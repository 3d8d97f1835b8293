"""Routing of live samples into recordings.

State of a source: its windows, and what is held back: samples, starts and
stops, until the source's newest publish time is past theirs by the holdback.
They then count in order of publish time, so that a late stop or start still
decides. A cancellation takes effect at once. The holdback is measured in
publish time: results equal those of batch routing if nothing arrives later
than that.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "source long, row_id long, ts long, window_id long"
STATE = "windows string, held string, pending string, newest long"
#: Lifecycle before data at the same time; a flush last of all.
ORDER = {"stop": 0, "start": 1, "cancel": 2, "data": 3, "flush": 4}


class Source:
    """Windows [id, start, routing bound, stop], held samples [row_id, ts] and pending starts and stops [ts, order, item, kind] of one source."""

    def __init__(self, windows: list[list], held: list[list], newest: int, pending: list[list] | None = None):
        self.windows, self.held, self.newest, self.pending = windows, held, newest, pending or []
        self._live = next((w for w in reversed(windows) if w[2] is None), None)

    def live(self) -> list | None:
        return self._live

    def offer(self, kind: str, ts: int, item: int) -> None:
        """Takes an event as it arrives: starts and stops wait for their turn."""
        if kind in ("start", "stop"):
            self.pending.append([ts, ORDER[kind], item, kind])
            self.newest = max(self.newest, ts)
        else:
            self.take(kind, ts, item)

    def advance(self, until: int | None) -> None:
        """Starts and stops up to ``until`` take effect, in order."""
        due = [p for p in self.pending if until is None or p[0] <= until]
        self.pending = [p for p in self.pending if until is not None and p[0] > until]
        for ts, _, item, kind in sorted(due):
            self.take(kind, ts, item)

    def take(self, kind: str, ts: int, item: int) -> None:
        if kind == "start":
            before = self._live
            if before:  # the next start bounds what a window without a stop takes in
                before[2], before[3] = ts, before[3] or ts
            self._live = [item, ts, None, None]
            self.windows.append(self._live)
        elif kind == "stop":
            own = self._live
            if own and own[1] <= ts:
                own[2] = own[3] = ts
                self._live = None
            else:  # the stop of an earlier window came late: it changes its row, not what it took in
                past = next((w for w in reversed(self.windows) if w[1] <= ts), None)
                if past:
                    past[3] = ts
        elif kind == "cancel":
            self.windows, self.held, self._live = [], [h for h in self.held if h[1] > ts], None
            self.pending = [p for p in self.pending if p[0] > ts]
        elif kind == "data":
            self.held.append([item, ts])
        self.newest = max(self.newest, ts)

    def windows_of(self, times: list[int]) -> list[int | None]:
        """For each time the window: closed ones first, the newest of them; then the live one. One pass in order of time."""
        closed = sorted((w for w in self.windows if w[2] is not None and w[2] > w[1]), key=lambda w: (w[1], w[0]))
        own = self._live
        out: list[int | None] = [None] * len(times)
        begun: list[tuple[int, int, int]] = []
        at = 0
        for k in sorted(range(len(times)), key=times.__getitem__):
            ts = times[k]
            while at < len(closed) and closed[at][1] <= ts:
                heapq.heappush(begun, (-closed[at][1], -closed[at][0], closed[at][2]))
                at += 1
            while begun and begun[0][2] <= ts:  # over for all later times too
                heapq.heappop(begun)
            out[k] = -begun[0][1] if begun else own[0] if own and own[1] <= ts else None
        return out

    def release(self, until: int | None) -> list[tuple[int, int, int | None]]:
        go = [h for h in self.held if until is None or h[1] <= until]
        self.held = [h for h in self.held if until is not None and h[1] > until]
        return [(i, ts, w) for (i, ts), w in zip(go, self.windows_of([h[1] for h in go]), strict=True)]

    def forget(self, before: int) -> None:
        self.windows = [w for w in self.windows if w[2] is None or w[2] >= before]


def route_stream(events: DataFrame, holdback_us: int = 500_000, retention_us: int | None = None) -> DataFrame:
    """Routes a stream of (source, kind, ts, item): a row per sample, window_id null for orphans.

    ``item``: the window's id for a start, the sample's for data. A ``flush``
    releases all that its source holds. Closed windows are kept for
    ``retention_us`` (twice the holdback by default).
    """
    keep = 2 * holdback_us if retention_us is None else retention_us

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows, held, pending, newest = state.get if state.exists else ("[]", "[]", "[]", -(1 << 62))
        own = Source(json.loads(windows), json.loads(held), newest, json.loads(pending))
        rows = pd.concat(list(batches))
        rows = rows.assign(rank=rows["kind"].map(ORDER)).sort_values(["ts", "rank", "item"], kind="stable")
        flush = (rows["kind"] == "flush").any()
        for kind, ts, item in zip(rows["kind"].tolist(), rows["ts"].tolist(), rows["item"].tolist(), strict=True):
            if kind != "flush":
                own.offer(kind, ts, item)
        until = None if flush else own.newest - holdback_us
        own.advance(until)
        out = own.release(until)
        own.forget(own.newest - keep)
        state.update((json.dumps(own.windows), json.dumps(own.held), json.dumps(own.pending), own.newest))
        if out:
            yield pd.DataFrame({"source": [key[0]] * len(out), "row_id": [o[0] for o in out], "ts": [o[1] for o in out], "window_id": pd.array([o[2] for o in out], dtype="Int64")})

    return events.groupBy("source").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
