"""Audio frames from whole sound and from parts."""

import random

import pytest

from clipweave import sources as src
from tests.conftest import rows


@pytest.mark.parametrize("longest", [1, 7, 40, 400])
def test_parts_give_the_frames_of_the_whole(spark, longest):
    """Parts far shorter and longer than a frame of 16 bytes, in any order, with gaps, empty and null ones."""
    rng = random.Random(longest)
    whole, parts = [], []
    for video in range(6):
        data = rng.randbytes(rng.choice([0, 15, 16, 17, 500, 999]))
        whole.append((video, bytearray(data)))
        at = no = 0
        while at < len(data):
            size = rng.randint(0, longest)
            parts.append((video, no, bytearray(data[at : at + size])))
            at, no = at + size, no + rng.randint(1, 3)
        parts.append((video, no, None))
    rng.shuffle(parts)
    frames = lambda df: [(v, f, bytes(b)) for v, f, b in rows(df)]
    got = src.chunk_audio_parts(spark.createDataFrame(parts, "video_id long, part_no int, pcm binary"), 8000, 1)
    want = src.chunk_audio(spark.createDataFrame(whole, "video_id long, pcm binary"), 8000, 1)
    assert frames(got) == frames(want) and len(frames(want)) == sum(len(d) // 16 for _, d in whole)


def test_only_the_ends_of_parts_are_grouped(spark):
    """The exchanges are those of the offsets, of the join by part, and one of the pieces; none deals whole frames."""
    df = spark.createDataFrame([(1, 0, bytearray(100))], "video_id long, part_no int, pcm binary")
    plan = src.chunk_audio_parts(df, 8000, 1)._jdf.queryExecution().executedPlan().toString()
    whole = plan[plan.index("Union") : plan.index("ObjectHashAggregate")]
    assert "hashpartitioning(_frame" not in whole and "frame_no" in whole
    assert "SortMergeJoin" in whole or "BroadcastHashJoin" in whole
