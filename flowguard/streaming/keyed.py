"""Keyed state of the streams: flow windows and anomaly velocity, one processor each.

Spark shuffles the rows of a batch by key, restores each key's state from the checkpoint and calls the processor, so a
lost executor or a restart repeats a batch from the same state. The state store has to be RocksDB
(``streams.run_available`` sees to it): state then lies on disk and is not bounded by an executor's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOW_BITS = 20
NAN = float("nan")
KEY = "_key"


def state_key(key: Column) -> Column:
    """The key as text that is never null: null keys would not be grouped, as a null is unlike another in Python."""
    return F.when(key.isNull(), "-").otherwise(F.concat(F.lit("="), key.cast("string"))).alias(KEY)


def key_value(kind: DataType) -> Column:
    return F.when(F.col(KEY) != "-", F.expr(f"substring({KEY}, 2)")).cast(kind)


def _square_sum(gaps: np.ndarray) -> int:
    """Exact sum of squares; a microsecond gap squared may leave 64 bits."""
    high, low = gaps >> LOW_BITS, gaps & ((1 << LOW_BITS) - 1)
    parts = [int((x * y).sum()) for x, y in ((high, high), (high, low), (low, low))]
    return ((parts[0] << LOW_BITS) + 2 * parts[1] << LOW_BITS) + parts[2]


class FlowWindows(StatefulProcessor):
    """Event counts, gaps and sums per key and tumbling window, from rows ``t, start, end, v``.

    ``open`` is the summary of the key's current window: its last time and exact integer sums. Rows newer than
    the watermark wait in ``pending``, as earlier ones may still come; what the watermark has passed is put in
    order of time and added to the summary. So a key holds one summary and the rows of the last ``delay``. A timer at
    the end of the oldest window wakes a key that gets no more rows.
    """

    SUMMARY = "upto bigint, start bigint, end bigint, n bigint, first bigint, last bigint, squares string, gmin bigint, gmax bigint, total double, values bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.SUMMARY)
        self.pending = handle.getListState("pending", "t bigint, start bigint, end bigint, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["t", "start", "end", "v"]] for r in rows], ignore_index=True)
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, None, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, new: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else None
        if new is not None and state is not None:
            new = new[new["t"] > state[0]]  # behind what is added already
        waiting = pd.DataFrame(list(self.pending.get()), columns=["t", "start", "end", "v"]) if self.pending.exists() else None
        parts = [x for x in (waiting, new) if x is not None and len(x)]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("t", "start", "end", "v")})
        passed = rows["t"].to_numpy(np.int64) <= watermark
        done, current = [], state[1:] if state is not None and state[1] is not None else None
        for group in self._windows(rows[passed]):
            if current is not None and current[0] == group[0]:
                current = self._merged(current, group)
                continue
            if current is not None:
                done.append(current)
            current = group
        if current is not None and current[1] <= watermark:
            done.append(current)
            current = None
        rest = rows[~passed]
        self._keep(current, rest, watermark)
        if done:
            yield self._table(key, done)

    def _keep(self, current, rest: pd.DataFrame, watermark: int) -> None:
        if len(rest):
            floats = rest["v"].astype(float)
            self.pending.put([(int(t), int(s), int(e), None if math.isnan(v) else v)
                              for t, s, e, v in zip(rest["t"], rest["start"], rest["end"], floats)])
        else:
            self.pending.clear()
        if current is None and not len(rest):
            # What is behind the watermark now is dropped before it gets here.
            self.open.clear()
            return
        self.open.update((max(watermark, 0), *(current if current is not None else (None,) * 10)))
        ends = [current[1]] if current is not None else []
        self.handle.registerTimer(int(min(ends + ([int(rest["end"].min())] if len(rest) else []))) // 1000)

    @staticmethod
    def _windows(rows: pd.DataFrame):
        """Summaries of the windows of ``rows``, in order of time."""
        rows = rows.sort_values("t", kind="stable")
        t, start, end = (rows[c].to_numpy(np.int64) for c in ("t", "start", "end"))
        v = rows["v"].to_numpy(float)
        cuts = np.flatnonzero(np.diff(start)) + 1
        for at in np.split(np.arange(len(t)), cuts) if len(t) else ():
            gaps, values = np.diff(t[at]), v[at][~np.isnan(v[at])]
            low, high = (int(gaps.min()), int(gaps.max())) if len(gaps) else (None, None)
            yield (int(start[at[0]]), int(end[at[0]]), len(at), int(t[at[0]]), int(t[at[-1]]), str(_square_sum(gaps)), low, high,
                   float(values.sum()), len(values))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        """One window from an earlier and a later part."""
        jump = b[3] - a[4]
        least = [x for x in (a[6], b[6], jump) if x is not None]
        most = [x for x in (a[7], b[7], jump) if x is not None]
        return (a[0], a[1], a[2] + b[2], a[3], b[4], str(int(a[5]) + int(b[5]) + jump * jump), min(least), max(most), a[8] + b[8], a[9] + b[9])

    def _table(self, key, done: list[tuple]) -> pd.DataFrame:
        rows = []
        for start, end, n, first, last, squares, low, high, total, values in done:
            span, pairs = last - first, n - 1
            mean = span / 1e6 / pairs if pairs else NAN
            std = math.sqrt(max(float(pairs * int(squares) - span * span), 0.0)) / pairs / 1e6 if pairs else NAN
            rows.append((start, end, n, span / 1e6, mean, std, NAN if low is None else low / 1e6, NAN if high is None else high / 1e6,
                         n / (span / 1e6) if span else NAN, total if values else NAN))
        out = pd.DataFrame(rows, columns=["start", "end", "n_events", "duration_s", "iat_mean", "iat_std", "iat_min", "iat_max", "events_per_s", "value_sum"])
        out.insert(0, KEY, key[0])
        return out


class VelocityEscalation(StatefulProcessor):
    """Decisions as they arrive, raised where a sliding window of the key holds too many anomalies, from rows ``id, slot, action, odd``.

    ``slots`` counts the key's anomalies by slide; a window is ``width`` slides. A row in a window with more than
    ``limit`` anomalies that says ALLOW becomes QUARANTINE, open windows included. An ALLOW that is not raised yet
    waits, by id, until its last window is behind the watermark; anomalies that come meanwhile make it a second,
    raised row. So the last word on every id does not depend on how the rows were split into batches.
    """

    def __init__(self, id_type: str, slide_micros: int, width: int, limit: int):
        self.id_type, self.slide, self.width, self.limit = id_type, slide_micros, width, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getListState("slots", "slot bigint, n bigint")
        self.waiting = handle.getListState("waiting", f"id {self.id_type}, slot bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, list(rows), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        counts = dict(self.slots.get()) if self.slots.exists() else {}
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        for rows in new:
            for slot, n in rows.loc[rows["odd"].astype(bool), "slot"].value_counts().items():
                counts[int(slot)] = counts.get(int(slot), 0) + int(n)
        busiest: dict[int, int] = {}

        def most(slot: int) -> int:
            """Anomalies of the busiest window over ``slot``."""
            if slot not in busiest:
                near = [counts.get(slot + i * self.slide, 0) for i in range(1 - self.width, self.width)]
                busiest[slot] = max(sum(near[i: i + self.width]) for i in range(self.width))
            return busiest[slot]

        out, still = [], []
        for row_id, slot in waiting:
            if most(slot) > self.limit:
                out.append((row_id, "ALLOW", "QUARANTINE", most(slot)))
            else:
                still.append((row_id, slot))
        for rows in new:
            for row_id, slot, action in zip(rows["id"].tolist(), rows["slot"].astype(int).tolist(), rows["action"].tolist()):
                raised = action == "ALLOW" and most(slot) > self.limit
                out.append((row_id, action, "QUARANTINE" if raised else action, most(slot)))
                if action == "ALLOW" and not raised:
                    still.append((row_id, slot))
        self._keep(counts, still, watermark)
        if out:
            table = pd.DataFrame(out, columns=["id", "action", "escalated_action", "n_anomalies"])
            table.insert(0, KEY, key[0])
            yield table

    def _keep(self, counts: dict[int, int], still: list[tuple], watermark: int) -> None:
        live = lambda slot: slot + self.width * self.slide > watermark
        slots = [(s, n) for s, n in sorted(counts.items()) if live(s)]
        ids = [x for x in still if live(x[1])]
        for state, rows in ((self.slots, slots), (self.waiting, ids)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if slots or ids:
            oldest = min([s for s, _ in slots] + [s for _, s in ids])
            self.handle.registerTimer((oldest + self.width * self.slide) // 1000)
