"""The tracker as a stream: one state for each clip, frames in strict order, tracks emitted once they have ended.

Confirmation, corroboration and interpolation look back over a track's whole life, so an open track is never emitted. Frames are made
small and gray before they reach the state. A frame that comes too early waits there; when too many wait, the missing ones are given up. One
that comes too late is counted and left out; rows carry the count. A clip ends with a row with ``last``, or when it was idle for so long.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pixels import gray, to_image
from ..operators.tracker import TRACK_ROWS, ClipTracker, Track, smaller, to_small, track_rows
from ..params import BARE, Params
from ..schema import CLASSES

#: Input: frames with their detections as parallel lists; ``last`` marks a clip's end.
INPUT = "clip_id string, frame_idx int, width int, height int, channels int, pixels binary, cls array<string>, boxes array<array<int>>, last boolean"
SMALL = "clip_id string, frame_idx int, width int, height int, small binary, cls array<string>, boxes array<array<int>>, last boolean"
#: Output: track rows, and how many frames of the clip had come too late by then.
STREAM_ROWS = TRACK_ROWS + ", late long"
STATE = "blob binary"
#: Frames that wait for a missing one at most.
WAITING_MOST = 256


def _shrink(parts: Iterator[pd.DataFrame], params: Params) -> Iterator[pd.DataFrame]:
    for p in parts:
        images = [smaller(gray(to_image(r.pixels, r.width, r.height, r.channels)), params.track_downscale).tobytes() for r in p.itertuples()]
        yield p.drop(columns=["channels", "pixels"]).assign(small=images)[[c.split(" ")[0] for c in SMALL.split(", ")]]


class TrackProcessor(StatefulProcessor):
    def __init__(self, params: Params = BARE, face_interval: int = 1, idle_ms: int | None = None, waiting_most: int = WAITING_MOST):
        self.params, self.face_interval, self.idle_ms, self.waiting_most = params, face_interval, idle_ms, waiting_most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("tracker", STATE)

    def _held(self) -> tuple[ClipTracker | None, int, dict, int]:
        held = self.state.get() if self.state.exists() else None
        return pickle.loads(held[0]) if held else (None, 0, {}, 0)

    def _advance(self, tracker: ClipTracker | None, due: int, r: dict) -> ClipTracker:
        tracker = tracker or ClipTracker(r["width"], r["height"], self.params, self.face_interval)
        listed = zip(r["cls"], r["boxes"], strict=True) if r["cls"] is not None else ()
        dets = sorted(((c, tuple(int(v) for v in b)) for c, b in listed), key=lambda d: CLASSES.index(d[0]))
        tracker.advance(due, to_small(r["small"], r["width"], r["height"], self.params), dets)
        return tracker

    def _rows(self, clip_id: str, tracks: list[Track], late: int) -> pd.DataFrame:
        return track_rows(clip_id, tracks).assign(late=late)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        tracker, due, waiting, late = self._held()
        for part in rows:
            for r in part.itertuples():
                if r.frame_idx < due:
                    late += 1
                else:
                    waiting[int(r.frame_idx)] = r._asdict()
        out, ended = [], False
        while waiting and not ended:
            if due not in waiting:
                if len(waiting) <= self.waiting_most:
                    break
                due = min(waiting)  # those before it are given up
            r = waiting.pop(due)
            tracker, ended, due = self._advance(tracker, due, r), bool(r["last"]), due + 1
        if tracker:
            out = tracker.all_tracks() if ended else tracker.closed
            tracker.closed = []
        if ended:
            self._forget()
        else:
            self.state.update((pickle.dumps((tracker, due, waiting, late)),))
            if self.idle_ms is not None:
                self._clear_timers()
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key[0], out, late)

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        """The clip was idle: what waits is taken in as it is, and all tracks end."""
        tracker, due, waiting, late = self._held()
        for due in sorted(waiting):
            tracker = self._advance(tracker, due, waiting[due])
        self._forget()
        yield self._rows(key[0], tracker.all_tracks() if tracker else [], late)

    def _clear_timers(self) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def _forget(self) -> None:
        self.state.clear()
        if self.idle_ms is not None:
            self._clear_timers()

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, params: Params = BARE, face_interval: int = 1, idle_ms: int | None = None, waiting_most: int = WAITING_MOST) -> DataFrame:
    """Track rows of ended tracks, with the clip's late frames so far. Needs the RocksDB state store; ``idle_ms`` works by processing time."""
    small = frames.mapInPandas(partial(_shrink, params=params), SMALL)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return small.groupBy("clip_id").transformWithStateInPandas(TrackProcessor(params, face_interval, idle_ms, waiting_most), STREAM_ROWS, "Append", mode)
