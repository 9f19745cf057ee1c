"""Every registered query against its SQL twin, and the shape of its plan."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from clipweave import operators as op
from clipweave.checks import tables as t
from clipweave.checks.queries import QUERIES
from clipweave.checks.sql import ORACLES as SQL
from clipweave.operators.items import EXIT_CODES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want and got


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


STREAMED = {"approve_stream", "smooth_stream", "smooth_stream_with_losses", "items_stream", "items_stream_runs", "settle_stream"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_plan_has_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert node not in plan


def test_limits_run_before_the_shuffle(spark, sf_dir, tmp_path):
    def table(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    detections = table("detections", t.detections(spark, sf_dir, 60))
    streams = table("streams", t.streams(spark, sf_dir))
    spans = table("spans", op.candidate_spans(t.segments(spark, sf_dir)))
    for df, kind in (
        (op.rank_streams(streams), "row_number()"),
        (op.best_span(spans, F.col("span_s")), "row_number()"),
        (op.unique_faces(detections), "rank("),
        (op.nms(detections), "row_number()"),
    ):
        limits = [line for line in plan_of(df).splitlines() if "WindowGroupLimit" in line]
        assert any("Partial" in line and kind in line for line in limits)


def test_a_hot_video_is_dealt_anew(spark, sf_dir):
    """Input dealt by video alone (a bucketed table, a join) gets a further exchange on a finer key."""
    def by_video(df):
        return df.repartition(4, "video_id")

    detections, segments = by_video(t.detections(spark, sf_dir, 60)), by_video(t.segments(spark, sf_dir))
    spans = op.best_span(op.candidate_spans(segments), F.col("span_s"))
    for df in (
        op.build_transcript(segments),
        op.motion_centroid(by_video(t.motion(spark, sf_dir))),
        op.nms(detections),
        op.unique_faces(detections),
        op.largest_face(detections),
        op.span_text(by_video(spans), segments),
    ):
        assert "hashpartitioning(_" in plan_of(df)


def test_every_outcome_occurs(spark, sf_dir):
    funnel = QUERIES["outcome_funnel"](spark, sf_dir)
    assert {r.status for r in funnel.collect()} == set(EXIT_CODES)


def test_best_spans_are_among_all_spans(spark, sf_dir):
    best, every = QUERIES["best_span"](spark, sf_dir), QUERIES["all_spans"](spark, sf_dir)
    assert best.join(every, ["video_id", "first_idx", "last_idx"], "left_anti").isEmpty()
    clips = QUERIES["many_clips"](spark, sf_dir)
    assert best.join(clips, "video_id", "left_anti").isEmpty()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["zip_audio"](spark, sf_dir))
    assert "props" not in plan and "value" not in plan
    plan = plan_of(QUERIES["first_answer"](spark, sf_dir))
    assert "EqualTo(event_type,view)" in plan and "props" not in plan


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["video_id", "clip_idx", "seg_idx", "text", "start_s", "end_s", "status"]
    assert df.count() > 0
