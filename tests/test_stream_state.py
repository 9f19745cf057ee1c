"""The stateful stream operators step by step, over a stand-in for the state store."""

import datetime
import random

import pandas as pd
import pytest

from clipweave.operators.motion import KEEP_SHARE, NEW_SHARE
from clipweave.streaming.attempts import BLOCK, _Attempts, _settle_block
from clipweave.streaming.smoothing import _Smoother


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Map:
    def __init__(self):
        self.rows = {}

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))

    def clear(self):
        self.rows.clear()


class Store:
    """State and timers of one key; ``watermark`` fires what is due, in order."""

    def __init__(self, processor):
        self.made, self.timers, self.now, self.processor = {}, set(), 0, processor
        self.out = []
        processor.init(self)

    def getValueState(self, name, _):
        return self.made.setdefault(name, Value())

    def getMapState(self, name, *_):
        return self.made.setdefault(name, Map())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.fired

    def _keep(self, frames):
        for f in frames:
            self.out += [tuple(None if pd.isna(x) else x for x in r) for r in f.itertuples(index=False)]

    def rows(self, *rows, columns):
        self._keep(self.processor.handleInputRows((7,), iter([pd.DataFrame(rows, columns=columns)]), self))

    def watermark(self, ms):
        self.now = ms
        while due := sorted(t for t in self.timers if t <= ms):
            self.fired = due[0]
            self.timers.discard(due[0])
            self._keep(self.processor.handleExpiredTimer((7,), self, self))


def at(seconds):
    return pd.Timestamp(datetime.datetime.fromtimestamp(seconds, datetime.UTC))


REPLY = ["ts", "attempt", "failed", "start_s", "stop_s", "answer"]


def reply(s, attempt, failed=False):
    return (at(s), attempt, failed, 10 + attempt, 90 + attempt, None)


def answer(s, text):
    return (at(s), None, None, None, None, text)


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([reply(100, 0)], (7, 0, 10, 90, True, "approve")),
        ([reply(100, 0), answer(110, "n")], (7, 0, 10, 90, True, "cancel")),
        ([reply(100, 0), answer(116, "n")], (7, 0, 10, 90, True, "approve")),  # after the timeout of 15 s
        ([reply(100, 0), answer(115, " N ")], (7, 0, 10, 90, True, "cancel")),
        ([reply(100, 0), answer(110, "n"), answer(105, "y")], (7, 0, 10, 90, True, "approve")),  # the first counts
        ([reply(100, 0), answer(105, "r"), answer(105, "n")], (7, 0, 10, 90, True, "cancel")),  # the smallest of one time
        ([answer(90, "n"), reply(100, 0)], (7, 0, 10, 90, True, "approve")),  # before the prompt
        ([reply(100, 0), answer(105, "r"), reply(200, 1)], (7, 1, 11, 91, True, "approve")),
        ([reply(100, 0), answer(105, "R"), reply(200, 1), answer(206, "r"), reply(300, 2), answer(303, "n")], (7, 2, 12, 92, True, "cancel")),
        ([reply(100, 0), answer(105, "r"), reply(200, 1, True)], (7, 1, 11, 91, True, "regenerate_failed")),
        ([reply(100, 0, True), answer(101, "n")], (7, 0, 10, 90, False, "approve")),
        ([reply(100, 0), answer(105, "r")], None),  # the next reply has not come
        ([answer(105, "r")], None),
    ],
)
def test_attempts(events, want):
    """All at once, one by one, and in any order: the same end, once, and nothing kept but a flag."""
    rng = random.Random(3)
    for k in range(6):
        mine = events[:] if k < 2 else rng.sample(events, len(events))
        store = Store(_Attempts(15_000))
        if k % 2:
            for e in mine:
                store.rows(e, columns=REPLY)
        else:
            store.rows(*mine, columns=REPLY)
        for s in (0, 104, 112, 116, 150, 1000, 2000):
            store.watermark(s * 1000)
        assert store.out == ([want] if want else [])
        if want:
            assert not store.made["replies"].rows and not store.made["answers"].rows and not store.timers
            store.rows(answer(1500, "n"), columns=REPLY)
            assert store.out == [want]


def test_a_decision_waits_for_the_watermark():
    store = Store(_Attempts(15_000))
    store.rows(reply(100, 0), answer(110, "n"), columns=REPLY)
    store.watermark(105_000)
    assert store.out == []
    store.rows(answer(107, "y"), columns=REPLY)  # out of order, but not late
    store.watermark(112_000)
    assert store.out == [(7, 0, 10, 90, True, "approve")]


class Group:
    """The state row of one block of videos."""

    def __init__(self):
        self.get, self.exists, self.now, self.timeout = None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, row):
        self.get, self.exists = row, True

    def setTimeoutTimestamp(self, ms):
        assert ms > self.now
        self.timeout = ms


def test_videos_of_a_block_are_settled_in_one_call():
    """Every video as if it were alone, whichever arrives first; one row of state and the earliest timer."""
    group, settle, out = Group(), _settle_block(15_000), []

    def call(now, *events):
        group.now, group.timeout = now * 1000, None
        rows = [(v, int(ts.timestamp() * 1000), *e) for v, ts, *e in events]
        frame = pd.DataFrame(rows, columns=["video_id", "ts_ms", *REPLY[1:]])
        for f in settle((0,), iter([frame]), group):
            out.extend(f.itertuples(index=False, name=None))

    typed = ["", "n", "r", "y"]
    call(0, *[(v, *answer(105 + v, typed[v % 4])) for v in range(8)])
    call(0, *[(v, *reply(100 + v, 0)) for v in range(BLOCK)], *[(v, *reply(200, 1, True)) for v in (2, 6)])
    assert out == [] and group.timeout == 105_001
    call(109, (70, *reply(300, 0)))  # an event of one wakes all that are due
    assert sorted((v, d) for v, _, _, _, _, d in out) == [(0, "approve"), (1, "cancel"), (2, "regenerate_failed"), (3, "approve")]
    assert group.timeout == 109_001
    call(1000)
    assert len(out) == BLOCK + 1 and len({r[0] for r in out}) == BLOCK + 1 and group.timeout is None
    assert {r[0] for r in out if r[5] == "cancel"} == {1, 5}
    assert all(done and not due and not replies and not answers for _, _, done, due, replies, answers in group.get[0])


SAMPLE = ["sample_no", "target", "ts"]


def smooth(targets):
    state, out = 0, []
    for no, target in sorted(targets.items()):
        if target is not None:
            state = int(KEEP_SHARE * state + NEW_SHARE * target)
        out.append((7, no, state))
    return out


def test_lost_samples_are_given_up_and_the_state_stays_small():
    rng = random.Random(9)
    sent = {n: rng.choice([None, rng.randrange(900)]) for n in range(3000) if n % 50 != 20}
    store, most = Store(_Smoother(gap_ms=10_000, idle_ms=60_000)), 0
    for n in sorted(sent, key=lambda n: n + rng.uniform(-2, 2)):
        store.rows((n, sent[n], at(n)), columns=SAMPLE)
        store.watermark(max(store.now, (n - 3) * 1000))
        most = max(most, len(store.made["early"].rows))
    store.watermark(3_100_000)
    assert store.out == smooth(sent)
    assert most <= 20
    assert not store.made["at"].exists() and not store.made["early"].rows  # released when idle


def test_without_a_gap_every_sample_is_waited_for():
    store = Store(_Smoother())
    sent = {n: n * 3 for n in range(40)}
    for n in sorted(sent, key=lambda n: (n % 7, n)):
        store.rows((n, sent[n], at(n)), columns=SAMPLE)
        store.rows((n, sent[n], at(n)), columns=SAMPLE)  # delivered twice
    assert store.out == smooth(sent) and not store.timers


def test_one_firing_gives_up_every_gap_that_is_due():
    """All samples are there before the watermark moves, and timers set while one fires wait for the next batch."""
    store = Store(_Smoother(gap_ms=10_000, idle_ms=60_000))
    sent = {n: n * 3 for n in range(2000) if n % 11 != 5}
    store.rows(*[(n, sent[n], at(n)) for n in sent], columns=SAMPLE)
    for now in (1_000_000, 3_000_000):
        store.now = now
        for ms in sorted(t for t in store.timers if t <= now):
            store.fired = ms
            store.timers.discard(ms)
            store._keep(store.processor.handleExpiredTimer((7,), store, store))
        assert len(store.out) == len([n for n in sent if now == 3_000_000 or n <= 995])
    assert store.out == smooth(sent)
    assert store.timers == {1_999_000 + 60_000}  # the state is kept until the video has been idle
