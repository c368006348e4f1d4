"""Segments of a camera's frames that roll over by length and end by a gap, at a constant rate.

Frames come in any order within the watermark's delay; a camera's frames wait in the state store until the watermark has
passed them and are then read in order. State is the open segment and what waits, so it is bounded by the delay."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


@dataclass(frozen=True)
class Rule:
    """Times in microseconds. A segment rolls over at the first frame that is `length` or more after its start, and the next one
    starts with that frame; it ends where no frame comes for longer than `gap`. Segments that last under `least_span` or hold
    under `least_size` are dropped. Between frames, one frame is due each `period`: missing ones are padded with the frame
    before, those that come too early are left out, and the end is padded to the segment's length (if it rolls over) or to its
    last frame."""

    length: int
    gap: int
    period: int
    least_span: int = 5_000_000
    least_size: int = 50_000


@dataclass
class Open:
    """The segment that is being written."""

    start: int
    last: int
    n_read: int = 0
    n_written: int = 0
    n_padded: int = 0
    n_dropped: int = 0
    size: int = 0
    any_written: bool = False

    def frame(self, at: int, size: int, rule: Rule) -> None:
        due = (at - self.start) // rule.period
        if self.any_written:
            self._pad(due - 1)
        if self.n_written < due:
            self.n_written += 1
            self.any_written = True
        else:
            self.n_dropped += 1
        self.last, self.n_read, self.size = at, self.n_read + 1, self.size + size

    def _pad(self, upto: int) -> None:
        more = max(0, upto - self.n_written)
        self.n_written += more
        self.n_padded += more

    def closed(self, rule: Rule) -> tuple[int, int, int, int, int, int, int] | None:
        span = self.last - self.start
        if self.any_written:
            self._pad(min(span, rule.length) // rule.period)
        if span < rule.least_span or self.size < rule.least_size:
            return None
        return self.start, span, self.n_read, self.n_written, self.n_padded, self.n_dropped, self.size


def rolled(now: Open | None, frames: list[tuple[int, int]], rule: Rule) -> tuple[Open | None, list[tuple]]:
    """The open segment and those that closed after frames (time, size) in order."""
    out = []
    for at, size in frames:
        if now is not None and at - now.last > rule.gap:
            out.append(now.closed(rule))
            now = None
        if now is None:
            now = Open(at, at)
        now.frame(at, size, rule)
        if at - now.start >= rule.length:
            out.append(now.closed(rule))
            now = Open(at, at)
    return now, [x for x in out if x]


OUT = "camera_id long, start_us long, span_us long, n_read long, n_written long, n_padded long, n_dropped long, size long"
STATE = "opened array<long>, times array<long>, sizes array<long>"


def rollover(frames: DataFrame, rule: Rule, late: str = "1 hour") -> DataFrame:
    """Closed segments of a stream of frames (camera_id, frame_id, at, us, size). A frame that comes twice within the delay
    counts once, one that comes after the watermark has passed it is dropped."""
    names = ["start", "last", "n_read", "n_written", "n_padded", "n_dropped", "size", "any_written"]
    once = frames.withWatermark("at", late).dropDuplicatesWithinWatermark(["camera_id", "frame_id"])

    def step(key, parts, state):
        opened, waiting = None, []
        if state.exists:
            held, times, sizes = state.get
            opened = Open(**dict(zip(names, [*held[:7], bool(held[7])], strict=True))) if len(held) else None
            waiting = list(zip(map(int, times), map(int, sizes), strict=True))
        if not state.hasTimedOut:
            for rows in parts:
                waiting += list(zip(rows["us"].astype("int64").tolist(), rows["size"].astype("int64").tolist(), strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[0] <= mark)
        waiting = [x for x in waiting if x[0] > mark]
        opened, out = rolled(opened, ready, rule)
        if opened is not None and mark > opened.last + rule.gap:
            out += [x] if (x := opened.closed(rule)) else []
            opened = None
        if opened is None and not waiting:
            if state.exists:
                state.remove()
        else:
            held = [int(v) for v in asdict(opened).values()] if opened else []
            state.update((held, [t for t, _ in waiting], [s for _, s in waiting]))
            due = min([t for t, _ in waiting] + ([opened.last + rule.gap + 1] if opened else []))
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in OUT.split(", ")])

    return once.groupBy("camera_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
