"""Crop smoothing while samples arrive, with one small state per video."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clipweave.functions.workers import ship_with_job
from clipweave.operators.motion import KEEP_SHARE, NEW_SHARE

ship_with_job(__name__)

OUTPUT = "video_id BIGINT, sample_no INT, smoothed_x INT"


class _Smoother(StatefulProcessor):
    """Keeps the next sample number, the offset, and samples that came too early.

    Of the early samples only the next one is looked up.  With ``gap_ms`` a gap has a deadline, counted from
    the sample behind it: when the timer fires the missing samples are given up and the offset is held, and so
    for every later gap that the watermark has passed too, so one firing settles all that is due.
    Without a gap a timer runs from the last sample and releases the state of the video.
    """

    def __init__(self, gap_ms: int | None = None, idle_ms: int | None = None) -> None:
        self._gap_ms, self._idle_ms = gap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._at = handle.getValueState("at", "next_no INT, smoothed INT, early INT, due_ms LONG")
        self._early = handle.getMapState("early", "sample_no INT", "target INT, ts_ms LONG")

    def _step(self, smoothed: int, target: int | None) -> int:
        return smoothed if target is None else int(KEEP_SHARE * smoothed + NEW_SHARE * target)

    def _go_on(self, key, state: tuple, ready: dict, seen_ms: int, waiting: list[int] | None = None, now_ms: int = 0) -> pd.DataFrame:
        """Settle samples from the next one on, from ``ready`` and the early ones; keep the rest and set the timer.

        ``waiting`` names the early samples in falling order, where gaps that are due at ``now_ms`` are given up.
        """
        next_no, smoothed, early, due_ms = state
        same_gap = early and next_no
        numbers, states = [], []
        while True:
            if next_no in ready:
                target, ms = ready.pop(next_no)
                # A copy may wait among the early ones.
                if early and self._early.containsKey((next_no,)):
                    self._early.removeKey((next_no,))
                    early -= 1
            elif early and self._early.containsKey((next_no,)):
                target, ms = self._early.getValue((next_no,))
                self._early.removeKey((next_no,))
                early -= 1
            else:
                while waiting and waiting[-1] < next_no:
                    waiting.pop()
                if not waiting or self._early.getValue((waiting[-1],))[1] + self._gap_ms > now_ms:
                    break
                next_no = waiting[-1]
                continue
            seen_ms = max(seen_ms, ms)
            smoothed = self._step(smoothed, target)
            numbers.append(next_no)
            states.append(smoothed)
            next_no += 1
        for no, sample in ready.items():
            early += not (early and self._early.containsKey((no,)))
            self._early.updateValue((no,), sample)
        if self._gap_ms is not None and not (early and due_ms and same_gap == next_no):
            if due_ms:
                self._handle.deleteTimer(due_ms)
            if early:
                behind = min(no for (no,) in self._early.keys())
                due_ms = self._early.getValue((behind,))[1] + self._gap_ms
            else:
                due_ms = seen_ms + self._idle_ms
            self._handle.registerTimer(due_ms)
        self._at.update((next_no, smoothed, early, due_ms))
        return pd.DataFrame({"video_id": key[0], "sample_no": numbers, "smoothed_x": states})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._at.get() if self._at.exists() else (0, 0, 0, 0)
        ready, seen_ms = {}, 0
        for batch in rows:
            times = [0] * len(batch) if self._gap_ms is None else [int(ts.timestamp() * 1000) for ts in batch["ts"]]
            seen_ms = max([seen_ms, *times])
            for no, target, ms in zip(batch["sample_no"], batch["target"], times):
                if no >= state[0]:  # a sample delivered twice is already done
                    ready[int(no)] = (None if pd.isna(target) else int(target), ms)
        yield self._go_on(key, state, ready, seen_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_no, smoothed, early, _ = self._at.get()
        if not early:
            self._at.clear()
            yield pd.DataFrame({"video_id": [], "sample_no": [], "smoothed_x": []})
            return
        waiting = sorted((no for (no,) in self._early.keys()), reverse=True)
        expired_ms = expiredTimerInfo.getExpiryTimeInMs()
        now_ms = max(expired_ms, timerValues.getCurrentWatermarkInMs())
        yield self._go_on(key, (waiting[-1], smoothed, early, 0), {}, expired_ms, waiting, now_ms)

    def close(self) -> None:
        pass


def smooth_stream(
    samples: DataFrame, gap_s: float | None = None, idle_s: float = 3600.0, lateness: str = "0 seconds"
) -> DataFrame:
    """The streaming form of ``smooth_track`` over ``(video_id, sample_no, target[, ts])``.

    Samples are numbered from 0, with a null target where nothing moved.  They may arrive in any
    order: one that comes early waits in the state until the gap before it is filled, so the result
    equals the batch form.

    Without ``gap_s`` every sample must arrive.  With it, ``ts`` is the event time: when the watermark is ``gap_s``
    past the sample behind a gap, the missing samples are given up and the offset is held over them, as the
    batch form does for missing rows.  So the state of a video is bounded by what arrives within ``gap_s``.  ``idle_s`` after the last sample the state is released; a sample after that starts the video anew.
    Needs the RocksDB state store.
    """
    if gap_s is None:
        processor, mode, columns = _Smoother(), "none", ["video_id", "sample_no", "target"]
    else:
        processor, mode = _Smoother(int(gap_s * 1000), int(idle_s * 1000)), "eventTime"
        columns = ["video_id", "sample_no", "target", "ts"]
        samples = samples.withWatermark("ts", lateness)
    return (
        samples.select(*columns)
        .groupBy("video_id")
        .transformWithStateInPandas(processor, OUTPUT, outputMode="append", timeMode=mode)
    )
