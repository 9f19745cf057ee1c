import math
import random

import pytest
from pyspark.sql import functions as F

from clipweave import operators as op
from clipweave import sources as src
from clipweave.plans.clips import clip_crops
from tests.conftest import rows

VIDEO = "video_id INT, width INT, height INT, fps DOUBLE"
DET = "video_id INT, frame_no INT, det_idx INT, confidence DOUBLE, x INT, y INT, x1 INT, y1 INT"


def videos(spark, *data):
    return spark.createDataFrame(list(data), VIDEO)


def test_vertical_dims(spark):
    v = videos(spark, (1, 1920, 1080, 30.0), (2, 1280, 720, 25.0), (3, 400, 854, 30.0), (4, 641, 481, 24.0))
    got = rows(op.vertical_dims(v).select("video_id", "vertical_w", "vertical_h", "dims_status"))
    assert got == [(1, 606, 1080, "ok"), (2, 404, 720, "ok"), (3, 480, 854, "too_narrow"), (4, 270, 480, "ok")]


def test_screen_scale(spark):
    v = videos(spark, (1, 1920, 1080, 30.0), (2, 500, 800, 30.0))
    got = rows(op.screen_scale(v).select("video_id", "scaled_w", "scaled_h", "offset_y", "max_x"))
    # 606 / (1920 * .67) = .4711: 904 x 508, (1080 - 508) // 2.  The second is too high: full height.
    assert got == [(1, 904, 508, 286, 298), (2, 500, 800, 0, 50)]


def test_scale_boxes_truncates_and_filters(spark):
    raw = spark.createDataFrame(
        [(1, 0, 0, 0.3, 0.1, 0.1, 0.2, 0.2), (1, 0, 1, 0.31, -0.0007, 0.5009, 0.9999, 1.01)],
        "video_id INT, frame_no INT, det_idx INT, confidence DOUBLE, rx DOUBLE, ry DOUBLE, rx1 DOUBLE, ry1 DOUBLE",
    )
    got = op.scale_boxes(raw, videos(spark, (1, 1920, 1080, 30.0))).select("det_idx", "x", "y", "x1", "y1")
    assert rows(got) == [(1, -1, 540, 1919, 1090)]


def test_largest_face_and_static_crop(spark):
    det = [
        (1, 0, 0, 1.0, 0, 0, 40, 40),
        (1, 0, 1, 1.0, 900, 0, 940, 40),  # same area, found later
        (1, 1, 0, 1.0, 0, 0, 29, 300),  # too narrow
        (1, 30, 0, 1.0, 0, 0, 400, 400),  # too late
        (2, 0, 0, 1.0, 1900, 0, 1930, 30),
    ]
    faces = op.largest_face(spark.createDataFrame(det, DET))
    assert rows(faces.select("video_id", "frame_no", "x", "w")) == [(1, 0, 0, 40), (2, 0, 1900, 30)]
    v = videos(spark, (1, 1920, 1080, 30.0), (2, 1920, 1080, 30.0), (3, 1280, 720, 25.0), (4, 400, 854, 30.0))
    assert rows(op.static_crop(faces, v)) == [
        (1, "face", 0), (2, "face", 1314), (3, "motion", 0), (4, "reject", None),
    ]


def test_static_crop_takes_the_upper_median(spark):
    faces = spark.createDataFrame(
        [(1, i, x, 0, 0, 30, 0) for i, x in enumerate([900, 500, 700, 600])],
        "video_id INT, frame_no INT, x INT, y INT, w INT, h INT, area LONG",
    )
    # Centres 500, 600, 700, 900: the third; 700 + 60 - 303.
    assert rows(op.static_crop(faces, videos(spark, (1, 1920, 1080, 30.0)))) == [(1, "face", 457)]


def test_two_clips_of_a_video_have_their_own_crops(spark):
    clips = spark.createDataFrame(
        [(1, 0, 2.0, 9.0), (1, 1, 3.99, 50.0), (1, 2, 100.0, 130.0), (4, 0, 1.0, 2.0)],
        "video_id INT, clip_idx INT, start_s DOUBLE, end_s DOUBLE",
    )
    det = [
        (1, 59, 0, 1.0, 0, 0, 400, 400),  # a frame before the first clip
        (1, 60, 0, 1.0, 500, 0, 600, 100),  # its first frame
        (1, 89, 0, 1.0, 700, 0, 800, 100),  # its frame 29: the upper median
        (1, 90, 0, 1.0, 0, 0, 400, 400),  # its frame 30
        (1, 119, 0, 1.0, 1000, 0, 1100, 100),  # 3.99 s at 30 frames a second is frame 119
        (1, 148, 0, 1.0, 1100, 0, 1200, 100),
        (1, 149, 0, 1.0, 0, 0, 400, 400),
    ]
    v = videos(spark, (1, 1920, 1080, 30.0), (4, 400, 854, 30.0))
    det = spark.createDataFrame(det, DET)
    shifted = op.clip_detections(clips, det, v).select("clip_idx", "frame_no", "x")
    assert rows(shifted) == [(0, 0, 500), (0, 29, 700), (1, 0, 1000), (1, 29, 1100)]
    assert rows(clip_crops(clips, det, v)) == [
        (1, 0, "face", 507), (1, 1, "face", 907), (1, 2, "motion", 0), (4, 0, "reject", None),
    ]


def test_unique_faces_keeps_the_crossing_frame_whole(spark):
    box = lambda v, f, d, x: (v, f, d, 1.0, x, 0, x + 10, 10)
    det = [box(1, 0, 0, 1), box(1, 0, 1, 1), box(1, 1, 0, 2), box(1, 1, 1, 3), box(1, 1, 2, 4), box(1, 2, 0, 5)]
    det += [box(2, 7, 0, 9)]
    got = rows(op.unique_faces(spark.createDataFrame(det, DET), k=3).select("video_id", "face_no", "first_frame", "x"))
    assert got == [(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 1, 3), (1, 3, 1, 4), (2, 0, 7, 9)]


def test_face_windows_floor(spark):
    faces = spark.createDataFrame(
        [(1, 0, 0, 800, 500, 101, 100), (1, 1, 0, 1850, 1000, 60, 60)],
        "video_id INT, face_no INT, first_frame INT, x INT, y INT, w INT, h INT",
    )
    v = videos(spark, (1, 1920, 1080, 30.0))
    got = rows(op.face_windows(faces, v).drop("video_id"))
    want = []
    th = int(1080 * 0.9)
    tw = int(th * 9 / 16)
    for n, x, y, w, h in [(0, 800, 500, 101, 100), (1, 1850, 1000, 60, 60)]:
        cx, cy = max(0, x + (w - tw) // 2), max(0, y + (h - th) // 2)
        want.append((n, tw, th, cx, cy, min(cx + tw, 1920), min(cy + th, 1080)))
    assert got == want
    frames = spark.range(3).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("frame_no"))
    assert op.face_crop_windows(frames, op.face_windows(faces, v)).count() == 6


def iou(a, b):
    w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
    size = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    union = size(a) + size(b) - w * h
    return w * h / union if union > 0 else 0.0


@pytest.mark.parametrize("top,keep", [(400, 200), (12, 5)])
def test_nms_against_brute_force(spark, top, keep):
    rng = random.Random(2)
    det = []
    for f in range(12):
        for d in range(rng.randint(1, 60)):
            x, y = rng.randint(0, 200), rng.randint(0, 200)
            det.append((1, f, d, rng.choice([0.0, 0.01, 0.5, 0.9, rng.random()]), x, y, x + rng.randint(0, 90), y + rng.randint(0, 90)))
    want = []
    for f in range(12):
        best = sorted((b for b in det if b[1] == f and b[3] > 0.01), key=lambda b: (-b[3], b[2]))[:top]
        kept = []
        for b in best:
            if all(iou(k, b) <= 0.45 for k in kept):
                kept.append(b)
        want += [(1, f, i, b[2]) for i, b in enumerate(kept[:keep])]
    got = op.nms(spark.createDataFrame(det, DET), top=top, keep=keep).select("video_id", "frame_no", "rank", "det_idx")
    assert rows(got) == sorted(want)


def test_sample_frames(spark):
    frames = spark.range(65).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("frame_no"))
    got = op.sample_frames(frames, videos(spark, (1, 10, 10, 29.97)))
    assert rows(got) == [(1, 0, 0), (1, 29, 1), (1, 58, 2)]


def test_speaker_track(spark):
    box = lambda f, d, y, y1: (1, f, d, 0.9, d, y, d + 9, y1)
    det = [box(1, 0, 0, 30), box(1, 1, 0, 60), box(1, 2, 10, 70), box(3, 0, 5, 5), box(9, 0, 0, 90)]
    frames = spark.range(6).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("frame_no"))
    audio = spark.createDataFrame(
        [(1, i, i != 3) for i in range(5)], "video_id INT, frame_no INT, is_speech BOOLEAN"
    )
    pairs = op.zip_audio(frames, audio)
    assert pairs.count() == 5
    track = op.active_speaker(spark.createDataFrame(det, DET), pairs)
    got = [(r.frame_no, r.lip, r.box and r.box.x, r.is_active) for r in track.orderBy("frame_no").collect()]
    # Boxes 1 and 2 of frame 1 both score 20: the first wins.
    assert got == [(0, None, None, False), (1, 20, 1, True), (2, None, None, False), (3, 0, 0, False), (4, None, None, False)]
    filled = op.fill_track(track).orderBy("frame_no").collect()
    assert [r.box and (r.box.x, r.box.y1) for r in filled] == [None, (1, 60), (1, 60), (0, 5), (0, 5)]


def test_lip_distance_floors(spark):
    det = [(1, 0, 0, 1.0, 0, 10, 5, 3), (1, 0, 1, 1.0, 0, 0, 5, 7)]
    got = op.lip_distance(spark.createDataFrame(det, DET)).orderBy("det_idx").collect()
    assert [r.lip for r in got] == [abs(10 + (2 * -7) // 3 - 3), abs(0 + (2 * 7) // 3 - 7)]


def test_chunk_audio_drops_the_partial_frame(spark):
    pcm = spark.createDataFrame(
        [(1, bytes(range(256)) * 10), (2, bytes(959)), (3, b"")], "video_id INT, pcm BINARY"
    )
    got = src.chunk_audio(pcm).orderBy("frame_no").collect()
    whole = bytes(range(256)) * 10
    assert [(r.video_id, bytes(r.frame)) for r in got] == [(1, whole[:960]), (1, whole[960:1920])]
    # One second of silence in 30 ms frames.
    silent = spark.createDataFrame([(1, bytes(32000))], "video_id INT, pcm BINARY")
    assert src.chunk_audio(silent).count() == math.floor(32000 / 960)


def test_segments_file(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(
        '{"video_id": 1, "segments": [{"text": " a", "start_s": 0, "end_s": 1.5}, {"text": " b", "start_s": 1.5, "end_s": 2}]}\n'
        '{"video_id": 2, "segments": []}\n{"video_id": 3}\n'
    )
    segments = src.read_segments(spark, str(path))
    assert rows(segments) == [(1, 0, " a", 0.0, 1.5), (1, 1, " b", 1.5, 2.0)]
    out = str(tmp_path / "flat")
    segments.write.parquet(out)
    assert rows(src.read_segments(spark, out, "parquet")) == rows(segments)
    all_videos = spark.range(1, 4).withColumnRenamed("id", "video_id")
    assert rows(op.pending_transcription(all_videos, segments)) == [(2,), (3,)]


def test_manifest_is_idempotent(spark, tmp_path):
    plan = spark.createDataFrame([(1, "planned"), (2, "too_narrow")], "video_id INT, status STRING")
    out = str(tmp_path / "plan")
    for _ in range(2):
        src.write_plan(plan, out)
    assert rows(spark.read.parquet(out).select("video_id", "status")) == [(1, "planned"), (2, "too_narrow")]
