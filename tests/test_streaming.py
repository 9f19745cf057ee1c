"""A stream that is run to its end equals the batch form."""

from datetime import datetime, timedelta

from clipweave import operators as op
from clipweave.checks import streams
from clipweave.checks import tables as t
from clipweave.streaming import approve_stream, items_stream, start_items
from tests.conftest import rows


def test_approvals(spark, sf_dir):
    batch = op.approve(t.prompts(spark, sf_dir), t.decisions(spark, sf_dir), timeout_s=3600.0)
    assert rows(streams.approvals(spark, sf_dir, timeout_s=3600.0)) == rows(batch)


def test_smoothing_with_samples_out_of_order(spark, sf_dir):
    batch = op.smooth_track(op.motion_centroid(t.motion(spark, sf_dir)), t.videos(spark, sf_dir))
    assert rows(streams.smoothing(spark, sf_dir)) == rows(batch)


def test_work_lists_are_picked_up_once_and_done_items_skipped(spark, tmp_path):
    lists, out, ckpt = tmp_path / "lists", str(tmp_path / "out"), str(tmp_path / "ckpt")
    lists.mkdir()
    done = spark.createDataFrame([("b", "success"), ("c", "failed")], "item_id STRING, status STRING")

    def drain():
        start_items(items_stream(spark, str(lists)), lambda: done, out, ckpt, once=True).awaitTermination()
        return rows(spark.read.parquet(out).select("item_id"))

    (lists / "1.txt").write_text(" a\n# x\n\nb\na\n")
    assert drain() == [("a",), ("a",)]
    (lists / "2.txt").write_text("c\nd\n")
    assert drain() == [("a",), ("a",), ("d",)]


def test_a_busy_user_is_not_paired_with_every_answer(spark, tmp_path):
    begun, second = datetime(2024, 1, 1, 0, 0, 3), timedelta(seconds=1)
    at = lambda s: begun + s * second
    asked = [(i, 1, at(i / 40)) for i in range(400)] + [(10_000 + u, u, at(u / 10)) for u in range(2, 60)]
    asked += [asked[7], (20_000, None, at(1))]
    given = [(1, at(i / 40 + 0.01), ("y", " R ", "n", "", None)[i % 5]) for i in range(360)]
    given += [(2, at(15.2), "n"), (3, at(15.300001), "n"), (4, at(9), "n"), (4, at(9), "R"), (5, at(0.49), "n")]
    given += [(6, at(3), None), (6, at(3), "n"), (7, at(4), None), (8, at(14), " n"), (8, at(13), "y"), (None, at(2), "n")]
    given += [(u, at(15 + u / 20), "r") for u in range(20, 60)]
    future = [at(86_400), at(2 * 86_400), at(3 * 86_400)]
    for n, (prompts, answers) in enumerate([(asked, given), *[([(-1, -1, f)], [(-1, f, "")]) for f in future]]):
        spark.createDataFrame(prompts, "prompt_id LONG, user_id LONG, ts TIMESTAMP").write.parquet(f"{tmp_path}/prompts/n={n}")
        spark.createDataFrame(answers, "user_id LONG, ts TIMESTAMP, answer STRING").write.parquet(f"{tmp_path}/answers/n={n}")
        if n == 0:
            schemas = [spark.read.parquet(f"{tmp_path}/{x}/n=0").schema for x in ("prompts", "answers")]
        source = lambda name, like: spark.readStream.schema(like).parquet(f"{tmp_path}/{name}/*")
        stream = approve_stream(source("prompts", schemas[0]), source("answers", schemas[1]), 15.0)
        query = (
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if n == 0:  # far fewer rows of state than events: a slot's users share them
            users = len({user for _, user, _ in asked})
            assert max(sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress) <= 3 * users

    def decision(user, ts):
        times = [(t, a is None, a) for u, t, a in given if u is not None and u == user and ts <= t <= ts + 15 * second]
        typed = (min(times, key=lambda x: (x[0], x[1], x[2] or ""))[2] or "").strip().lower() if times else None
        return "approve_timeout" if typed is None else {"r": "regenerate", "n": "cancel"}.get(typed, "approve")

    out = spark.read.parquet(f"{tmp_path}/out").where("prompt_id >= 0")
    assert rows(out.select("prompt_id", "decision")) == sorted((i, decision(u, ts)) for i, u, ts in set(asked))
