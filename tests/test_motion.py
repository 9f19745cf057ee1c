import math
import random

import pytest
from pyspark.sql import functions as F

from clipweave import operators as op
from clipweave.operators.motion import step
from tests.conftest import rows

# 1920 x 1080: vertical width 606, scaled width 904, so offsets run from 0 to 298.
VIDEOS = [(v, 1920, 1080, 30.0) for v in range(5)]


def videos(spark):
    return spark.createDataFrame(VIDEOS, "video_id INT, width INT, height INT, fps DOUBLE")


def test_step_sequence(spark):
    got, state = [], 0
    for target in (100, 100, 9, 9, 300):
        state = spark.range(1).select(step(F.lit(state), F.lit(target))).first()[0]
        got.append(state)
    assert got == [10, 19, 18, 17, 45]


def test_centroid(spark):
    motion = spark.createDataFrame(
        [
            (1, 0, 10, 0, 3.0, 0.0),
            (1, 0, 21, 0, 0.0, 3.0),
            (1, 0, 500, 0, 2.0, 0.0),  # not above the threshold
            (1, 1, 5, 0, 1.0, 1.0),
            (1, 2, 100, 0, 3.0, 4.0),
            (1, 2, 200, 0, 15.0, 0.0),
        ],
        "video_id INT, sample_no INT, x INT, y INT, fx DOUBLE, fy DOUBLE",
    )
    assert rows(op.motion_centroid(motion)) == [(1, 0, 15), (1, 1, None), (1, 2, 175)]


def walk(centroids):
    out = []
    for v in sorted({c[0] for c in centroids}):
        state = 0
        for _, no, x in sorted((c for c in centroids if c[0] == v), key=lambda c: c[1]):
            if no > 0 and x is not None:
                target = max(0, min(x - 303, 298))
                state = int(0.90 * state + 0.10 * target)
            out.append((v, no, state))
    return out


@pytest.mark.parametrize("chunk,fan", [(1, 2), (3, 2), (16, 3), (50, 4), (1024, 1024)])
def test_smoothing_in_runs_equals_one_walk(spark, chunk, fan):
    rng = random.Random(chunk)
    data = []
    for v, n in ((0, 400), (1, 60), (2, 1), (3, 17)):
        x = 400.0
        for no in range(n):
            x = min(max(x + rng.uniform(-150, 150), 0), 903)
            if rng.random() > 0.1:  # some samples are missing altogether
                data.append((v, no, int(x) if rng.random() > 0.2 else None))
    df = spark.createDataFrame(data, "video_id INT, sample_no INT, centroid_x INT").repartition(3)
    got = op.smooth_track(df, videos(spark), chunk=chunk, fan=fan)
    assert rows(got) == walk(data)


def test_crop_per_frame_and_window(spark):
    track = spark.createDataFrame([(1, 0, 0), (1, 2, 40), (1, 3, 290)], "video_id INT, sample_no INT, smoothed_x INT")
    frames = spark.range(150).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("video_id"), F.col("id").cast("int").alias("frame_no"))
    got = op.crop_per_frame(frames, track, videos(spark))
    want = [(1, f, 0 if f < 60 else 40 if f < 90 else 290) for f in range(150)] + [(2, f, 0) for f in range(150)]
    assert rows(got) == want
    edges = spark.createDataFrame([(1, 0, 298), (1, 1, 299), (1, 2, 903)], "video_id INT, frame_no INT, smoothed_x INT")
    assert rows(op.crop_window(edges, videos(spark))) == [(1, 0, 298, 904), (1, 1, 298, 904), (1, 2, 298, 904)]


def test_track_carries_over_frame_chunks(spark, monkeypatch):
    from clipweave.operators import motion

    monkeypatch.setattr(motion, "FRAME_SAMPLES", 2)
    track = spark.createDataFrame([(1, 1, 25)], "video_id INT, sample_no INT, smoothed_x INT")
    frames = spark.range(600).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("frame_no"))
    got = op.crop_per_frame(frames, track, videos(spark))
    assert rows(got) == [(1, f, 0 if f < 30 else 25) for f in range(600)]


def plain_ranges(clip, mode, x_start, samples, video):
    """One clip frame by frame: (first, last, x, x2) of every run of frames with one offset."""
    _, _, start, end, _ = clip
    fps, width, vw, sw = video
    step, begin = int(fps), math.floor(start * fps)
    state, seen, out = 0, False, []
    for f in range(math.floor(end * fps) - begin):
        if mode == "face":
            x, top = x_start, width
        else:
            no, rest = divmod(begin + f, step)
            if rest == 0 and no in samples:
                if samples[no] is not None and no > -(-begin // step):
                    target = max(0, min(samples[no] - vw // 2, sw - vw))
                    state = int(0.90 * state + 0.10 * target)
            x, top = state, sw
        right = min(x + vw, top)
        left = max(0, right - vw) if right - x < vw else x
        if out and out[-1][2:] == (left, right):
            out[-1] = (out[-1][0], f, left, right)
        else:
            out.append((f, f, left, right))
    return out


def test_crop_ranges_equal_frames_one_by_one(spark):
    """Odd rates, overlapping clips, missing samples, faces, rejected clips and clips without samples."""
    rng = random.Random(5)
    rates = {1: 29.97, 2: 25.0, 3: 23.976, 4: 30.0, 5: 60.0}
    videos = spark.createDataFrame([(v, 1920, 1080, f) for v, f in rates.items()], "video_id long, width int, height int, fps double")
    sized = {r["video_id"]: (r["fps"], r["width"], r["vertical_w"], r["scaled_w"]) for r in op.screen_scale(videos).collect()}
    centroids = {v: {n: rng.choice([None, rng.randrange(1800)]) for n in range(200) if rng.random() < 0.9} for v in (1, 2, 3, 5)}
    clips, crops = [], []
    for v in rates:
        for i in range(5):
            start = rng.randrange(0, 150)
            end = start + rng.choice([0.5, 3.0, 40.3, 119.9])
            clips.append((v, i, start, end, end - start))
            mode = rng.choice(["motion", "motion", "face", "reject"])
            crops.append((v, i, mode, {"motion": 0, "face": rng.randrange(1300), "reject": None}[mode]))
    got = op.crop_ranges(
        spark.createDataFrame(clips, "video_id long, clip_idx int, start_s int, end_s double, clip_s double"),
        spark.createDataFrame(crops, "video_id long, clip_idx int, mode string, x_start int"),
        spark.createDataFrame([(v, n, x) for v, s in centroids.items() for n, x in s.items()], "video_id long, sample_no int, centroid_x int"),
        videos,
    )
    want = []
    for clip, (v, i, mode, x) in zip(clips, crops):
        if mode != "reject":
            # Smoothing numbers samples from the clip's first one, which never moves the crop.
            for k, r in enumerate(plain_ranges(clip, mode, x, centroids.get(v, {}), sized[v])):
                want.append((v, i, k, mode, *r))
    assert rows(got) == sorted(want)
    motion = {(v, i) for v, i, m, _ in crops if m == "motion"}
    assert motion and motion == {(r[0], r[1]) for r in want if r[3] == "motion"}
    assert any(r[2] > 3 for r in want)
