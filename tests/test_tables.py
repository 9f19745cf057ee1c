"""Derived tables: what a query does not ask for is not computed, and wide columns are not sorted."""

import re

from clipweave.checks import tables as t
from clipweave.checks.queries import QUERIES
from clipweave.operators.captions import caption_counts
from tests.conftest import rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lengths_are_the_end_of_the_last_segment_and_need_no_segments(spark, tmp_path):
    texts = ["One two. Three!  Four", "", " ", "a.\n b?\t", "x\x1ey z. \x1e", "No mark", "a. b. c. d. e.", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id LONG, text STRING")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    ends = t.segments(spark, d).groupBy("video_id").agg({"end_s": "max"}).collect()
    assert {r[0]: r[1] for r in rows(t.durations(spark, d))} == {7: None, **{v: end + 60.0 for v, end in ends}}
    assert "Generate" not in plan(t.durations(spark, d))


def test_sizes_of_videos_count_no_words(spark, sf_dir):
    assert "regexp" not in plan(t.videos(spark, sf_dir).select("video_id", "width", "fps"))


def test_overlay_styles_are_made_behind_the_join(spark, sf_dir):
    found = plan(QUERIES["overlay_style"](spark, sf_dir))
    assert "map" not in found[found.index("Join") :].lower()


def test_blank_captions_of_any_white_space_are_not_counted(spark):
    texts = ["a", " ", "  \t", "", " b ", "　c", None]
    segments = spark.createDataFrame([(1, k, x, 10.0 + k, 11.0 + k) for k, x in enumerate(texts)], "video_id LONG, seg_idx INT, text STRING, start_s DOUBLE, end_s DOUBLE")
    clips = spark.createDataFrame([(1, 0, 5.0, 60.0)], "video_id LONG, clip_idx INT, start_s DOUBLE, clip_s DOUBLE")
    counted = caption_counts(clips, segments)
    assert rows(counted) == [(1, 0, 3)]
    assert not re.search("regexp_replace", plan(counted))
