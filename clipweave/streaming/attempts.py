"""Approval over several attempts: ask, regenerate, ask again, with a timeout for each."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from clipweave.functions.workers import ship_with_job
from clipweave.operators.decisions import APPROVAL_TIMEOUT_S

ship_with_job(__name__)

OUTPUT = "video_id BIGINT, attempt INT, start_s INT, stop_s INT, highlight_ok BOOLEAN, decision STRING"
_NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
_EVENT = ["attempt", "failed", "start_s", "stop_s", "answer"]

# Videos whose ids are neighbours share a state row: handing over a group costs far more than a video does.
BLOCK = 64
STATE = """videos ARRAY<STRUCT<video_id: LONG, attempt: INT, done: BOOLEAN, due_ms: LONG,
    replies: ARRAY<STRUCT<attempt: INT, ts_ms: LONG, failed: BOOLEAN, start_s: INT, stop_s: INT>>,
    answers: ARRAY<STRUCT<ts_ms: LONG, answer: STRING>>>>"""


class _Attempts(StatefulProcessor):
    """Keeps the open attempt of a video, replies that have come, and answers not yet used.

    A prompt is open from its reply until its timeout.  It is settled when the watermark has passed
    its first answer in that time, or its end, so an answer that arrives late but in order counts.
    """

    def __init__(self, timeout_ms: int) -> None:
        self._timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._at = handle.getValueState("at", "attempt INT, done BOOLEAN, due_ms LONG")
        self._replies = handle.getMapState("replies", "attempt INT", "ts_ms LONG, failed BOOLEAN, start_s INT, stop_s INT")
        self._answers = handle.getMapState("answers", "ts_ms LONG", "answer STRING")

    def _settle(self, key, state: tuple, now_ms: int) -> list[tuple]:
        attempt, done, due_ms = state
        out, wake_ms = [], 0
        while not done and self._replies.containsKey((attempt,)):
            begun, failed, start, stop = self._replies.getValue((attempt,))
            if failed:
                out.append((key[0], attempt, start, stop, attempt > 0, "regenerate_failed" if attempt else "approve"))
                done = True
                break
            times = sorted(ms for (ms,) in self._answers.keys() if begun <= ms <= begun + self._timeout_ms)
            until = times[0] if times else begun + self._timeout_ms
            if until >= now_ms:
                wake_ms = until + 1
                break
            typed = self._answers.getValue((times[0],))[0].strip().lower() if times else ""
            self._replies.removeKey((attempt,))
            # Answers given up to now are used or too early for the next prompt.
            for (ms,) in list(self._answers.keys()):
                if ms <= until:
                    self._answers.removeKey((ms,))
            if typed == "r":
                attempt += 1
                continue
            out.append((key[0], attempt, start, stop, True, "cancel" if typed == "n" else "approve"))
            done = True
        if due_ms:
            self._handle.deleteTimer(due_ms)
        if done:
            self._replies.clear()
            self._answers.clear()
        if wake_ms:
            self._handle.registerTimer(wake_ms)
        self._at.update((attempt, done, wake_ms))
        return out

    def events(self, key, rows: Iterable[tuple], now_ms: int) -> list[tuple]:
        """Take in ``(ts_ms, attempt, failed, start_s, stop_s, answer)`` and settle what can be."""
        state = self._at.get() if self._at.exists() else (0, False, 0)
        for ms, attempt, failed, start, stop, answer in rows:
            if state[1]:
                break
            if not pd.isna(attempt):
                if attempt >= state[0]:
                    whole = [None if pd.isna(x) else int(x) for x in (start, stop)]
                    self._replies.updateValue((int(attempt),), (ms, bool(failed), *whole))
                continue
            answer = "" if answer is None else answer
            if self._answers.containsKey((ms,)):  # of answers at one time the smallest counts
                answer = min(answer, self._answers.getValue((ms,))[0])
            self._answers.updateValue((ms,), (answer,))
        return self._settle(key, state, now_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = ((int(ts.timestamp() * 1000), *e) for batch in rows for ts, *e in zip(batch["ts"], *[batch[c] for c in _EVENT]))
        yield pd.DataFrame(self.events(key, events, timerValues.getCurrentWatermarkInMs()), columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, done, _ = self._at.get()
        yield pd.DataFrame(self._settle(key, (attempt, done, 0), timerValues.getCurrentWatermarkInMs()), columns=_NAMES)

    def close(self) -> None:
        pass


class _Value:
    """A value in a state row."""

    def __init__(self, row: tuple | None) -> None:
        self.row = row

    def exists(self) -> bool:
        return self.row is not None

    def get(self) -> tuple:
        return self.row

    def update(self, row: tuple) -> None:
        self.row = row


class _Map:
    """A map in a state row."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        self.rows = {(key,): tuple(value) for key, *value in rows}

    def containsKey(self, key: tuple) -> bool:
        return key in self.rows

    def getValue(self, key: tuple) -> tuple:
        return self.rows[key]

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.rows[key] = value

    def removeKey(self, key: tuple) -> None:
        del self.rows[key]

    def keys(self) -> Iterator[tuple]:
        return iter(self.rows)

    def clear(self) -> None:
        self.rows.clear()


class _VideoState:
    """The state of one video within a state row; its timer is the ``due_ms`` of ``at``."""

    def __init__(self, at: tuple | None = None, replies: Iterable[tuple] = (), answers: Iterable[tuple] = ()) -> None:
        self._made = {"at": _Value(at), "replies": _Map(replies), "answers": _Map(answers)}

    def getValueState(self, name: str, schema: str) -> _Value:
        return self._made[name]

    def getMapState(self, name: str, key_schema: str, schema: str) -> _Map:
        return self._made[name]

    def registerTimer(self, ms: int) -> None:
        pass

    def deleteTimer(self, ms: int) -> None:
        pass

    def due_ms(self) -> int:
        return self._made["at"].row[2]

    def stored(self) -> tuple:
        replies, answers = ([(*k, *v) for k, v in self._made[name].rows.items()] for name in ("replies", "answers"))
        return (*self._made["at"].row, replies, answers)


def _settle_block(timeout_ms: int) -> Callable:
    """Settle the videos of one state row: those with events and those whose wait is over."""

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now_ms, processor, out = state.getCurrentWatermarkMs(), _Attempts(timeout_ms), []
        stored = state.get[0] if state.exists else ()
        videos = {video: _VideoState(tuple(at), replies, answers) for video, *at, replies, answers in stored}
        events = defaultdict(list, {video: [] for video, kept in videos.items() if 0 < kept.due_ms() <= now_ms})
        for frame in frames:
            for video, *event in zip(*[frame[c] for c in ("video_id", "ts_ms", *_EVENT)]):
                events[video].append(event)
        for video, rows in events.items():
            processor.init(videos.setdefault(video, _VideoState()))
            out += processor.events((video,), rows, now_ms)
        state.update(([(video, *kept.stored()) for video, kept in videos.items()],))
        if due := [kept.due_ms() for kept in videos.values() if kept.due_ms()]:
            state.setTimeoutTimestamp(min(due))
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return settle


def settle_stream(
    replies: DataFrame, answers: DataFrame, timeout_s: float = APPROVAL_TIMEOUT_S, lateness: str = "0 seconds"
) -> DataFrame:
    """The streaming form of ``settle_attempts``: where asking ended, as replies and answers arrive.

    ``replies`` is ``(video_id, attempt, ts, status, start_s, stop_s)``: each parsed highlight, numbered from 0, at the
    time it is shown.  ``answers`` is ``(video_id, ts, answer)``; the first answer within ``timeout_s`` of the open
    prompt counts: ``r`` asks for the next attempt, ``n`` cancels, anything else and silence approve.  A reply
    that failed ends the chain.  A row is emitted once the watermark has passed the decision.

    The state of a video is its open attempt, replies ahead of it and answers not yet used; of a settled
    video one flag.  Up to ``BLOCK`` videos with neighbouring ids share a state row, which travels with their events.
    """
    shown = replies.select(
        "video_id", "ts", F.col("attempt").cast("int").alias("attempt"), (F.col("status") != "ok").alias("failed"), "start_s", "stop_s"
    )
    events = shown.unionByName(answers.select("video_id", "ts", "answer"), allowMissingColumns=True)
    return (
        events.withWatermark("ts", lateness)
        .withColumn("ts_ms", F.unix_millis("ts"))
        .withColumn("_block", F.floor(F.col("video_id") / BLOCK))
        .groupBy("_block")
        .applyInPandasWithState(_settle_block(int(timeout_s * 1000)), OUTPUT, STATE, "append", "EventTimeTimeout")
    )
