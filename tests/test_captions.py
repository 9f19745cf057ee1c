import random

import pytest
from pyspark.sql import functions as F

from clipweave import operators as op
from tests.conftest import rows

CLIP = "video_id INT, clip_idx INT, start_s INT, end_s DOUBLE, clip_s DOUBLE"
SEG = "video_id INT, seg_idx INT, text STRING, start_s DOUBLE, end_s DOUBLE"


def brute(clips, segs):
    out = []
    for v, c, start, _, length in clips:
        hit = False
        for sv, i, text, s, e in segs:
            a, b = s - start, e - start
            if sv == v and b > 0 and a < length:
                hit = True
                if text.strip():
                    out.append((v, c, i, text.strip(), max(0.0, a), min(length, b), "caption"))
        if not hit:
            out.append((v, c, None, None, None, None, "no_overlap"))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def check(spark, clips, segs):
    got = op.clip_captions(spark.createDataFrame(clips, CLIP), spark.createDataFrame(segs, SEG))
    assert rows(got) == brute(clips, segs)
    return rows(got)


def test_strict_overlap_shift_and_clamp(spark):
    segs = [
        (1, 0, " touches the start", 0.0, 10.0),
        (1, 1, "\tcrosses the start ", 8.0, 12.5),
        (1, 2, "   ", 12.5, 13.0),
        (1, 3, "crosses the end", 19.0, 25.0),
        (1, 4, "touches the end", 20.0, 22.0),
        (2, 0, " ", 5.0, 6.0),
    ]
    clips = [(1, 0, 10, 20.0, 10.0), (2, 0, 5, 7.0, 2.0), (3, 0, 1, 9.0, 8.0), (1, 1, 100, 110.0, 10.0)]
    got = check(spark, clips, segs)
    # Only blank text: captioned with nothing, so no row at all.  No overlap: one row.
    assert not [r for r in got if r[0] == 2]
    assert [r[0] for r in got if r[6] == "no_overlap"] == [1, 3]
    assert (1, 0, 1, "crosses the start", 0.0, 2.5, "caption") in got


def test_random_against_brute_force(spark):
    """Short and very long segments and clips over many buckets; one video holds most."""
    rng = random.Random(7)
    segs, clips = [], []
    for i in range(1500):
        v = 1 if rng.random() < 0.6 else rng.randint(2, 20)
        s = round(rng.uniform(0, 3000), 1)
        segs.append((v, i, rng.choice(["x", " y ", " "]), s, round(s + rng.choice([0.1, 3, 64, 200, 900]), 1)))
    for i in range(40):
        s = rng.choice([0, 63, 64, 65, 128, rng.randint(0, 4000)])
        length = rng.choice([0.5, 63.9, 64.0, 120.0, 1000.0])
        clips.append((rng.randint(1, 22), i, s, s + length, length))
    check(spark, clips, segs)


def test_layout(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 3.5, 606, 1080, 50), ("b", 1.0, 2.0, 404, 720, None), (None, None, None, 404, 720, 1)],
        "text STRING, start_s DOUBLE, end_s DOUBLE, width INT, height INT, text_h INT",
    )
    got = [(r.font_size, r.box_width, r.pos_y, r.shown_s, r.color) for r in op.caption_layout(df).collect()]
    assert got == [(70, 506, 930, 2.5, "#2699ff"), (46, 304, None, 1.0, "#2699ff")]


def test_overlay_colour_counts_before_the_filter(spark):
    segs = [(1, 0, "a", 0.0, 0.4), (1, 1, "b", 0.4, 1.0), (1, 2, "c", 1.0, 1.5), (1, 3, "d", 2.0, 3.0)]
    got = op.overlay_plan(spark.createDataFrame(segs, SEG)).select("seg_idx", "color")
    assert rows(got) == [(1, "yellow"), (2, "yellow"), (3, "white")]


def test_style_merge_and_use(spark):
    df = spark.createDataFrame(
        [
            (1, 0.0, 5.5, {"animation_style": "fade", "fade_duration": "0.1", "margin_bottom": "100", "position": "center,bottom"}),
            (2, 0.0, 0.1, {"animation_style": "fade", "fade_duration": "0.1", "max_width": "77"}),
            (3, 0.0, 1.0, {"animation_style": "fade", "fade_duration": "0"}),
            (4, 0.0, 1.0, None),
        ],
        "id INT, start_s DOUBLE, end_s DOUBLE, over MAP<STRING, STRING>",
    ).withColumns({"width": F.lit(1280), "height": F.lit(720), "text_h": F.lit(40)})
    styled = df.withColumn("style", op.merge_style(op.default_style(), F.col("over")))
    got = rows(op.overlay_style(styled).select("id", "box_width", "fade_s", "pos_y"))
    assert got == [(1, 1024, 0.1, 580), (2, 77, 0.05, None), (3, 1024, None, None), (4, 1024, None, None)]
    style = styled.where("id = 1").first().style
    assert style["animation_style"] == "fade" and style["font"] == "DejaVu-Sans-Bold"


@pytest.mark.parametrize("chunk_s", [1, 600])
def test_first_answer_against_brute_force(spark, chunk_s):
    rng = random.Random(3)
    prompts = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 5000)) for i in range(300)]
    answers = [(rng.choice([1, 1, 2, 3, 4]), rng.randint(0, 5000), rng.choice("ynr")) for _ in range(200)]
    answers += [(u, t + 15, "n") for _, u, t in prompts[:20]]  # exactly at the limit counts
    want = []
    for i, u, t in prompts:
        hits = sorted((at, a) for au, at, a in answers if au == u and t <= at <= t + 15)
        want.append((i, u, hits[0][1], (hits[0][0] - t) * 1_000_000) if hits else (i, u, None, None))
    ts = F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts")
    p = spark.createDataFrame(prompts, "prompt_id INT, user_id INT, t INT").select("prompt_id", "user_id", ts)
    d = spark.createDataFrame(answers, "user_id INT, t INT, answer STRING").select("user_id", ts, "answer")
    assert rows(op.first_answer(p, d, 15, chunk_s)) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_approve(spark):
    ts = F.timestamp_seconds(F.col("t")).alias("ts")
    p = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0)], "prompt_id INT, user_id INT, t INT")
    d = spark.createDataFrame(
        [(1, 15, ""), (2, 3, " R\n"), (2, 4, "n"), (3, 1, "N"), (4, 16, "n"), (5, 0, "whatever")],
        "user_id INT, t INT, answer STRING",
    ).select("user_id", ts, "answer")
    p = p.select("prompt_id", "user_id", ts)
    assert [r[2] for r in rows(op.approve(p, d))] == [
        "approve", "regenerate", "cancel", "approve_timeout", "approve",
    ]
    assert {r[2] for r in rows(op.approve(p, d, auto_approve=True))} == {"approve"}
