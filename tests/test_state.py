"""State of runs, unattended runs, lists as they land, and sinks that are written again."""

import pytest
from pyspark.sql import functions as F

from clipweave import sources as src
from clipweave.plans import run_until
from clipweave.sources.state import last_batch
from clipweave.streaming import items_stream, start_runs
from tests.conftest import rows

OUT = "item_id string, outcome string"


def test_a_batch_written_twice_counts_once_and_the_latest_wins(spark, tmp_path):
    path = str(tmp_path / "state")
    src.init_state(spark, path)
    assert src.read_state(spark, path).count() == 0 and last_batch(spark, path) == -1
    first = spark.createDataFrame([("a", "success"), ("b", "crashed")], OUT)
    for _ in range(2):
        src.write_outcomes(first, path, 0)
    src.write_outcomes(spark.createDataFrame([("b", "success"), ("c", "no_audio")], OUT), path, 1)
    src.init_state(spark, path)
    want = [("a", "success", "success", 0), ("b", "success", "success", 1), ("c", "failed", "no_audio", 1)]
    assert rows(src.read_state(spark, path)) == want
    assert rows(src.read_state(spark, path, before=1)) == [("a", "success", "success", 0), ("b", "failed", "crashed", 0)]


def test_a_run_that_is_stopped_gives_the_same_rows(spark, tmp_path):
    outcome = F.when(F.pmod(F.col("line_no"), F.lit(3)) == 1, "success").otherwise("crashed")
    items = spark.range(60).select(F.col("id").alias("line_no"), F.concat(F.lit("v"), F.col("id") % 40).alias("item_id"))
    asked = []

    def run(todo):
        asked.extend(r["item_id"] for r in todo.collect())
        return todo.select("item_id", outcome.alias("outcome"))

    whole = rows(run_until(items, run, str(tmp_path / "one"), 7, 6))
    assert [r[0] for r in whole] == list(range(20)) and sum(r[2] == "success" for r in whole) == 7
    asked.clear()
    for k in range(6):
        last = rows(run_until(items, run, str(tmp_path / "two"), 7, 6, max_batches=1 if k < 5 else None))
    assert last == whole and len(asked) == len(set(asked)) == 24
    # All items done: it ends although the wanted number is not reached.
    assert len(rows(run_until(items, run, str(tmp_path / "one"), 1000, 25))) == 40


def test_failures_are_tried_again_once(spark, tmp_path):
    items = spark.range(4).select(F.col("id").alias("line_no"), F.col("id").cast("string").alias("item_id"))
    state = str(tmp_path / "state")
    run_until(items, lambda t: t.select("item_id", F.lit("crashed").alias("outcome")), state, 9, 3)
    later = run_until(items, lambda t: t.select("item_id", F.when(F.col("line_no") < 2, "success").otherwise("crashed").alias("outcome")), state, 9, 3, retry_failures=True)
    assert [r[2] for r in rows(later)] == ["success", "success", "failed", "failed"]


def test_a_list_that_is_run_again_leaves_one_row_per_item(spark, tmp_path):
    lists, state = tmp_path / "lists", str(tmp_path / "state")
    lists.mkdir()
    (lists / "1.txt").write_text("a\nb\n# no\n")
    run = lambda todo: todo.select("item_id", F.lit("success").alias("outcome"))

    def drain(checkpoint):
        start_runs(items_stream(spark, str(lists)), run, state, str(tmp_path / checkpoint), once=True).awaitTermination()
        return rows(src.read_state(spark, state))

    assert drain("k1") == [("a", "success", "success", 0), ("b", "success", "success", 0)]
    # A lost checkpoint: batch 0 comes again with a longer list, and replaces itself.
    (lists / "2.txt").write_text("b\nc\n")
    assert drain("k2") == [("a", "success", "success", 0), ("b", "success", "success", 0), ("c", "success", "success", 0)]


def test_updates_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "plan")
    plan = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "bad")], "video_id long, status string")
    assert src.update_plan(plan, path, "r1") == 3
    for _ in range(2):
        assert src.update_plan(plan.where("video_id = 2"), path, "r2") == 1
    assert rows(src.read_plan(spark, path).select("video_id", "status", "run_id")) == [(2, "ok", "r2"), (3, "bad", "r1")]


def test_listing_reads_no_content(spark, tmp_path):
    for name in ("a/x.mp4", "a/b/y.mp4", "a/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    listed = src.list_files(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in listed.collect()) == [("x.mp4", 5), ("y.mp4", 5)]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_segments_written_and_read(spark, tmp_path, fmt):
    nested = spark.createDataFrame([(1, [(" a.", 0.0, 1.0), (" b", 1.0, 2.5)]), (2, None)], src.segments.FILE_SCHEMA)
    path = str(tmp_path / "s")
    (nested if fmt == "json" else src.explode_segments(nested)).write.format(fmt).save(path)
    assert rows(src.read_segments(spark, path, fmt)) == [(1, 0, " a.", 0.0, 1.0), (1, 1, " b", 1.0, 2.5)]
