"""Messages that wait in keyed state until the watermark has passed them.

A stream may bring messages in any order within the watermark's delay, so a
key's messages are taken in event order only once the watermark is beyond
them.  What waits lies in a map state, one entry for every slot of event time
that a micro-batch brought messages of: a micro-batch writes its own messages
and a short list of entries, whatever else waits, and a taken entry is removed
without being written again.  An event-time timer wakes the key when its next
message is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidelink.functions.temporal import ntz_to_instant

SLOT_US = 7 * 86_400_000_000  # event time that an entry spans at most
NEVER = (1 << 62) - 1


class Waiting:
    """The waiting messages of the current key: ``us`` (event time) and further columns (name to SQL type)."""

    def __init__(self, handle, name: str, columns: dict[str, str], slot_us: int = SLOT_US):
        kinds = {"us": "long", **columns}
        self.columns, self.slot_us = {c: np.int64 if kind == "long" else object for c, kind in kinds.items()}, slot_us
        self.entries = handle.getMapState(name, "part int", ", ".join(f"{c} array<{kind}>" for c, kind in kinds.items()))
        # Per entry its number, its next message that is due, and its last one.
        self.index = handle.getValueState(f"{name}_index", "part array<int>, due array<long>, last array<long>, next int")

    def _index(self) -> tuple[list, list, list, int]:
        found = self.index.get()
        return (list(found[0]), list(found[1]), list(found[2]), found[3]) if found else ([], [], [], 0)

    def add(self, rows: dict[str, np.ndarray]) -> int:
        """Append messages; returns the time of the earliest that waits."""
        part, due, last, number = self._index()
        us = rows["us"]
        slot = us // self.slot_us
        for s in np.unique(slot).tolist():
            mine = np.flatnonzero(slot == s)
            self.entries.updateValue((number,), tuple(rows[c][mine].tolist() for c in self.columns))
            part.append(number)
            due.append(int(us[mine].min()))
            last.append(int(us[mine].max()))
            number += 1
        self.index.update((part, due, last, number))
        return min(due)

    def take(self, until_us: int) -> tuple[dict[str, np.ndarray], int]:
        """Messages before ``until_us`` that were not taken yet, and the time of the next (never: a far one)."""
        part, due, last, number = self._index()
        found = [[np.empty(0, dtype=t)] for t in self.columns.values()]
        if not due or min(due) >= until_us:
            return {c: f[0] for c, f in zip(self.columns, found)}, min(due, default=NEVER)
        left = ([], [], [])
        for p, d, e in zip(part, due, last):
            if d < until_us:
                values = [np.array(v, dtype=t) for v, t in zip(self.entries.getValue((p,)), self.columns.values())]
                us = values[0]
                for f, v in zip(found, values):
                    f.append(v[(us >= d) & (us < until_us)])
                if e < until_us:
                    self.entries.removeKey((p,))
                    continue
                d = int(us[us >= until_us].min())
            for column, v in zip(left, (p, d, e)):
                column.append(v)
        if left[0]:
            self.index.update((*left, number))
        else:
            self.index.clear()
        return {c: np.concatenate(f) for c, f in zip(self.columns, found)}, min(left[1], default=NEVER)


class InOrder(StatefulProcessor):
    """A keyed step over messages in event order; subclasses give ``columns`` (name to SQL type) and ``step``.

    The input has the key, ``us`` and the columns, whose names have no leading underscore.
    """

    columns: dict[str, str] = {}

    def open(self, handle) -> None:
        """Further state of the subclass."""

    def step(self, key: tuple, rows: dict[str, np.ndarray], until_us: int):
        """Rows to return for messages that are now in order (unsorted here), as frames; next wake-up time."""
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, "waiting", self.columns)
        self.open(handle)

    def _wake(self, due_us: int) -> None:
        if due_us < NEVER:
            self.handle.registerTimer(due_us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        parts = list(rows)
        if parts:
            self._wake(self.waiting.add({c: np.concatenate([p[c].to_numpy(t) for p in parts]) for c, t in self.waiting.columns.items()}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        until_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows, due = self.waiting.take(until_us)
        frames, wake = self.step(key, rows, until_us)
        self._wake(min(due, wake))
        return iter(frames)

    def close(self) -> None:
        pass


def timed(stream: DataFrame, ts: str, watermark: str, *columns) -> DataFrame:
    """``us``, the watermarked instant ``instant``, and ``columns``."""
    instant = ntz_to_instant(ts)
    return stream.select(instant.alias("instant"), F.unix_micros(instant).alias("us"), *columns).withWatermark("instant", watermark)
