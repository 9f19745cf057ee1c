"""Streaming operators run over the given tables until all input is used.

The input is staged as files in the shared checkpoint folder, read as a stream,
and the sink is read back, so nothing passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.checks import tables as t
from clipweave.operators.highlights import parse_highlight
from clipweave.operators.motion import motion_centroid, targets
from clipweave.session import ensure_checkpoint_dir
from clipweave.sources.state import read_state
from clipweave.streaming import approve_stream, items_stream, settle_stream, smooth_stream, start_items, start_runs

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.session.timeZone": "UTC",
}
SENTINEL = -1


def stage_dir(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session for streams; ``partitions``: number of state partitions, else that of ``spark``."""
    session = spark.newSession()
    for key, value in STREAM_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    return session


def run_to_end(result: DataFrame, folder: str) -> str:
    """Run an append-mode query until its sources are used up; returns the sink path.

    Run again with the same folder it goes on where it stopped.
    """
    out = f"{folder}/out"
    query = (
        result.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def approvals(spark: SparkSession, sf_dir: str, timeout_s: float, slices: int = 2) -> DataFrame:
    """Prompts and answers arrive in slices of time, then rows far in the future.

    Each arrival is one batch, however many files it has, so nothing in it is late.
    The future rows only move the watermark past the last real wait; two arrivals of
    them are needed, since a watermark takes effect in the batch after.
    """
    folder = stage_dir(spark)
    prompts, decisions = t.prompts(spark, sf_dir), t.decisions(spark, sf_dir)
    micros = F.unix_micros("ts")
    low, high = prompts.unionByName(decisions, allowMissingColumns=True).agg(F.min(micros), F.max(micros)).first()
    step = (high - low) // slices + 1
    session = stream_session(spark)

    def source(name: str, like: DataFrame) -> DataFrame:
        return session.readStream.schema(like.schema).parquet(f"{folder}/{name}")

    def arrive(table: DataFrame, name: str) -> None:
        table.write.mode("append").parquet(f"{folder}/{name}")

    def future(table: DataFrame, days: int) -> DataFrame:
        ts = F.timestamp_micros(F.lit(high)) + F.expr(f"INTERVAL {days} DAYS")
        columns = [
            (ts if f.name == "ts" else F.lit(str(SENTINEL))).cast(f.dataType).alias(f.name) for f in table.schema
        ]
        return spark.range(1).select(*columns)

    arrivals = [
        [table.where(F.floor((micros - low) / step) == i) for table in (prompts, decisions)] for i in range(slices)
    ] + [[future(table, days) for table in (prompts, decisions)] for days in (30, 60)]
    for prompts_now, decisions_now in arrivals:
        arrive(prompts_now, "prompts")
        arrive(decisions_now, "decisions")
        result = approve_stream(source("prompts", prompts), source("decisions", decisions), timeout_s)
        out = run_to_end(result, folder)
    # Future rows are dropped behind the sink: a filter before it would be pushed below
    # the watermark and the last rows would never come out.
    return spark.read.parquet(out).where(F.col("prompt_id") != SENTINEL).select(
        "prompt_id", "user_id", "decision"
    )


def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd samples of every video arrive before the even ones."""
    folder = stage_dir(spark)
    samples = targets(motion_centroid(t.motion(spark, sf_dir)), t.sizes(spark, sf_dir)).select(
        "video_id", "sample_no", "target"
    )
    late = F.pmod(F.col("sample_no"), F.lit(2)) == 0
    samples.where(~late).write.mode("append").parquet(f"{folder}/samples")
    samples.where(late).write.mode("append").parquet(f"{folder}/samples")
    source = (
        stream_session(spark)
        .readStream.schema(samples.schema)
        .option("maxFilesPerTrigger", 4)
        .parquet(f"{folder}/samples")
    )
    return spark.read.parquet(run_to_end(smooth_stream(source), folder))


def smoothing_with_losses(spark: SparkSession, sf_dir: str, lost: int = 11) -> DataFrame:
    """Odd samples arrive before even ones and every ``lost``-th never does; a sample is one second of event time.

    Two rows far in the future move the watermark past all gaps.
    """
    folder = stage_dir(spark)
    second = F.timestamp_seconds(F.col("sample_no") + 1_000_000)
    samples = targets(motion_centroid(t.motion(spark, sf_dir)), t.sizes(spark, sf_dir)).select(
        "video_id", "sample_no", "target", second.alias("ts")
    )
    samples = samples.where(F.pmod(F.col("sample_no"), F.lit(lost)) != lost // 2)
    even = F.pmod(F.col("sample_no"), F.lit(2)) == 0
    session = stream_session(spark)

    def future(days: int) -> DataFrame:
        ts = F.timestamp_seconds(F.lit(1_000_000 + days * 86_400))
        return spark.range(1).select(
            F.lit(SENTINEL).cast("long").alias("video_id"), F.lit(days).alias("sample_no"), F.lit(None).cast("int").alias("target"), ts.alias("ts")
        )

    # Both halves are staged before the stream starts: they are one batch, so that no sample is late.
    arrivals = [samples.where(~even).unionByName(samples.where(even)), *[future(d) for d in (3000, 6000, 9000, 12000)]]
    for now in arrivals:
        now.write.mode("append").parquet(f"{folder}/samples")
        source = session.readStream.schema(samples.schema).parquet(f"{folder}/samples")
        out = run_to_end(smooth_stream(source, gap_s=60.0), folder)
    return spark.read.parquet(out).where(F.col("video_id") != SENTINEL)


def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as finished runs: every third one done, every third one failed."""
    kind = F.pmod(F.col("page_id"), F.lit(3))
    status = F.when(kind == 0, "success").when(kind == 1, "failed").otherwise("pending")
    return t.load(spark, sf_dir, "pages").select(F.col("url").alias("item_id"), status.alias("status"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_dir(spark)
    lines = t.lines(spark, sf_dir)
    lines.select("line").write.mode("append").text(f"{folder}/lists")
    session = stream_session(spark)
    query = start_items(
        items_stream(session, f"{folder}/lists", 1),
        lambda: page_state(session, sf_dir),
        f"{folder}/out",
        f"{folder}/state",
        once=True,
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("item_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even pages land first, then all lines: the second list runs only what the first has not."""
    folder = stage_dir(spark)
    session = stream_session(spark)
    kind = F.pmod(F.col("page_id"), F.lit(3))
    outcome = F.when(kind == 0, "success").when(kind == 1, "crashed").otherwise("no_audio")
    known = t.load(session, sf_dir, "pages").groupBy("url").agg(F.min(outcome).alias("outcome"))

    def run(todo: DataFrame) -> DataFrame:
        return todo.join(known, todo["item_id"] == known["url"]).select("item_id", "outcome")

    lines = t.lines(spark, sf_dir)
    for now in (lines.where(F.pmod(F.floor(F.col("line_no") / 2), F.lit(2)) == 0), lines):
        now.select("line").write.mode("append").text(f"{folder}/lists")
        start_runs(items_stream(session, f"{folder}/lists"), run, f"{folder}/runs", f"{folder}/state", once=True).awaitTermination()
    return read_state(spark, f"{folder}/runs")


def attempts(spark: SparkSession, sf_dir: str, timeout_s: float = 15.0) -> DataFrame:
    """Replies of three attempts and the answers to them arrive in two halves by video, then rows far in the future."""
    folder = stage_dir(spark)
    second = lambda k: F.timestamp_seconds(F.lit(1_000_000) + F.col("attempt") * 100 + k)
    own = t.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id")).distinct()
    replies = parse_highlight(t.attempts(spark, sf_dir), keep=["attempt"]).join(own, "video_id", "left_semi")
    replies = replies.select("video_id", "attempt", second(0).alias("ts"), "status", "start_s", "stop_s")
    typed = F.when(F.col("decision") == "regenerate", " R ").when(F.col("decision") == "cancel", "n").otherwise("")
    answers = t.attempt_decisions(spark, sf_dir).select("video_id", second(5).alias("ts"), typed.alias("answer"))
    session = stream_session(spark)

    def future(days: int) -> tuple[DataFrame, DataFrame]:
        ts = F.timestamp_seconds(F.lit(1_000_000 + days * 86_400)).alias("ts")
        row = spark.range(1).select(F.lit(SENTINEL).cast("long").alias("video_id"), ts)
        nothing = F.lit(None)
        return (
            row.select("video_id", F.lit(0).alias("attempt"), "ts", F.lit("ok").alias("status"), nothing.cast("int").alias("start_s"), nothing.cast("int").alias("stop_s")),
            row.select("video_id", "ts", F.lit("").alias("answer")),
        )

    # Answers come before or with the replies they belong to; both wait in the state.
    for shown, given in [(replies.limit(0), answers), (replies, answers.limit(0)), future(30), future(60), future(90)]:
        shown.write.mode("append").parquet(f"{folder}/replies")
        given.write.mode("append").parquet(f"{folder}/answers")
        source = lambda name, like: session.readStream.schema(like.schema).parquet(f"{folder}/{name}")
        out = run_to_end(settle_stream(source("replies", replies), source("answers", answers), timeout_s, "1 hour"), folder)
    return spark.read.parquet(out).where(F.col("video_id") != SENTINEL)
