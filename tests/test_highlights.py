from clipweave import operators as op
from clipweave.plans import many_clips
from tests.conftest import rows
from pyspark.sql import functions as F


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "video_id INT, response STRING")
    return [
        (r.status, r.start_s, r.stop_s) for r in op.parse_highlight(df).orderBy("video_id").collect()
    ]


def test_statuses(spark):
    j = '{{"start": {}, "content": "c", "end": {}}}'.format
    assert parse(spark, None, "", "  ", "null") == [("empty", None, None)] * 4
    assert parse(spark, "not json", "{}", '{"start": 1, "end": 2}', "[]", f"[{j(1, 2)},{j(3, 4)}]") == [
        ("bad_structure", None, None)
    ] * 5
    assert parse(spark, j('"abc"', 5), j(1, '"x"'), j('"NaN"', 5), j("1e300", "2e300")) == [
        ("unparseable", None, None)
    ] * 4
    assert parse(spark, j(-5, 60), j(5, -2)) == [("negative", None, None)] * 2
    # Cut to whole seconds before any test: -0.5 is 0, 5.2 to 5.9 is empty.
    assert parse(spark, j(-0.5, 60.9), j(5.2, 5.9), j(9, 3)) == [
        ("ok", 0, 60),
        ("end_not_after_start", None, None),
        ("end_not_after_start", None, None),
    ]
    assert parse(spark, j(68, 187), f" [{j('68.9', 187.2)}] ", j('"12.5"', '"20"')) == [
        ("ok", 68, 187),
        ("ok", 68, 187),
        ("ok", 12, 20),
    ]


def test_zero_start_parses_but_does_not_pass(spark):
    df = spark.createDataFrame([(1, 0, 60), (2, 1, 60), (3, None, None)], "video_id INT, start_s INT, stop_s INT")
    assert rows(op.gate_highlights(df)) == [(2, 1, 60)]


def test_clamp(spark):
    ranges = spark.createDataFrame([(1, 10, 50), (2, 10, 200), (3, 100, 200)], "video_id INT, start_s INT, stop_s INT")
    videos = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0)], "video_id INT, duration_s DOUBLE")
    assert rows(op.clamp_clip(ranges, videos).select("video_id", "end_s", "clip_status")) == [
        (1, 50.0, "ok"),
        (2, 99.9, "ok"),
        (3, 99.9, "out_of_range"),
    ]


def test_prompt_pieces_join_to_the_messages(spark):
    segs = spark.createDataFrame(
        [(1, i, f" say {{{i}}}", float(i), i + 1.0) for i in range(10)],
        "video_id INT, seg_idx INT, text STRING, start_s DOUBLE, end_s DOUBLE",
    )
    transcript = "".join(f"{float(i)} - {i + 1.0}:  say {{{i}}}\n" for i in range(10))
    for part in (3, 4096):
        pieces = op.render_prompt(op.build_transcript(segs, part_segments=part))
        message = {"system": "", "user": ""}
        for r in sorted(pieces.collect(), key=lambda r: r.piece_no):
            message[r.role] += r.content
        assert message["user"] == transcript
        assert message["system"].endswith("## Input\n" + transcript + "\n")
        assert "[{\n    start:" in message["system"]


def test_transcript_variants_and_stats(spark):
    segs = spark.createDataFrame(
        [(1, 1, " b", 1.5, 2.0), (1, 0, " a" * 200, 0.0, 1.5)],
        "video_id INT, seg_idx INT, text STRING, start_s DOUBLE, end_s DOUBLE",
    )
    whole = "0.0 - 1.5: " + " a" * 200 + "\n1.5 - 2.0:  b\n"
    assert op.build_transcript(segs).first().transcript == whole
    assert op.build_transcript(segs, sep="").first().transcript == whole.replace("\n", "")
    assert rows(op.transcript_stats(segs)) == [(1, 2, len(whole), whole[:200])]


def test_many_clips_numbers_in_time_order(spark):
    spans = spark.createDataFrame(
        [(1, 0, 5, 0.0, 120.0), (1, 6, 9, 120.0, 240.5), (1, 3, 8, 60.0, 181.0), (1, 20, 30, 500.0, 620.0)],
        "video_id INT, first_idx INT, last_idx INT, start_s DOUBLE, end_s DOUBLE",
    )
    videos = spark.createDataFrame([(1, 600.0)], "video_id INT, duration_s DOUBLE")
    score = -F.abs(F.col("end_s") - F.col("start_s") - 120)
    # A clip that starts at 0 does not pass the gate but stays; the last one is cut at the end.
    assert rows(many_clips(spans, score, videos)) == [
        (1, 0, 0, 120.0, 120.0, "bad_highlight"),
        (1, 1, 120, 240.0, 120.0, "ok"),
        (1, 2, 500, 599.9, 99.89999999999998, "ok"),
    ]
    # It pushes out no span that passes, and is still there where nothing else is.
    assert [r.start_s for r in many_clips(spans, -F.col("start_s"), videos, single=True).collect()] == [60]
    alone = many_clips(spans.where("first_idx = 0"), score, videos, single=True)
    assert [(r.start_s, r.clip_status) for r in alone.collect()] == [(0, "bad_highlight")]


def test_attempts_end_at_the_first_that_is_not_regenerated(spark):
    data = [
        (1, 0, "ok", 5, 60, "regenerate"), (1, 1, "ok", 7, 70, "regenerate"), (1, 2, "ok", 9, 90, None),
        (2, 0, "ok", 5, 60, "regenerate"), (2, 1, "negative", None, None, None), (2, 2, "ok", 1, 9, "approve"),
        (3, 0, "empty", None, None, None), (3, 1, "ok", 5, 60, "approve"),
        (4, 0, "ok", 5, 60, "cancel"), (4, 1, "ok", 6, 60, "approve"),
    ]
    schema = "video_id INT, attempt INT, status STRING, start_s INT, stop_s INT, decision STRING"
    assert rows(op.settle_attempts(spark.createDataFrame(data, schema))) == [
        (1, 2, 9, 90, True, "approve"),
        (2, 1, None, None, True, "regenerate_failed"),
        (3, 0, None, None, False, "approve"),
        (4, 0, 5, 60, True, "cancel"),
    ]
