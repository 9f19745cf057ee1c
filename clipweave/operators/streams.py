"""Stream catalogue: which quality to fetch and whether audio comes separately."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions import strip
from clipweave.operators.ordered import dense_index

SHOWN = 5
MEGABYTE = 1024 * 1024
IDX_CHUNK = 4096


def resolution_lines(col: Column | str = "resolution") -> Column:
    """``1080p`` as 1080; a label without digits ranks last."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_extract(col, r"(\d+)", 1).try_cast("int"), F.lit(-1))


def _described(streams: DataFrame) -> DataFrame:
    return (
        streams.where(F.col("type") == "video")
        .withColumn("size_mb", F.round(F.col("filesize") / F.lit(MEGABYTE), 2))
        .withColumn("kind", F.when(F.col("is_progressive"), "Progressive").otherwise("Adaptive"))
        .withColumn("_lines", resolution_lines())
    )


def rank_streams(streams: DataFrame, k: int = SHOWN) -> DataFrame:
    """The ``k`` best video streams of each video, best first, ranked from 0.

    The limit on ``row_number`` is applied before the shuffle as well, so at most
    ``k`` rows per video and task are moved.
    """
    best = Window.partitionBy("video_id").orderBy(F.col("_lines").desc(), "stream_idx")
    ranked = _described(streams).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    return ranked.select(
        "video_id",
        (F.col("_n") - 1).alias("rank"),
        "stream_idx",
        "resolution",
        "size_mb",
        "kind",
    )


def choose_stream(streams: DataFrame, answers: DataFrame) -> DataFrame:
    """The stream each video is fetched in.

    ``answers(video_id, answer)``: digits below the number of video streams pick
    that rank, of the full list and not only of the ranks shown; anything else,
    or no answer, picks rank 0.
    """
    # Position in the full list: ordered by resolution, then stream_idx.  Chunks
    # follow that order, so a video with a huge list is ranked in parallel.
    chunk = -F.col("_lines").cast("long") * F.lit(1 << 32) + F.floor(F.col("stream_idx") / IDX_CHUNK)
    ranked = dense_index(
        _described(streams), ["video_id"], chunk, [F.col("_lines").desc(), F.col("stream_idx")], "rank"
    )
    typed = strip("answer")
    picks = answers.select("video_id", typed.try_cast("bigint").alias("_pick"), typed.alias("_typed"))
    asked = F.col("_typed").rlike("^[0-9]+$") & (F.col("rank") == F.col("_pick"))
    # Rank 0 and, if there is one, the rank asked for: the higher of the two counts.
    found = ranked.join(picks, "video_id", "left").where((F.col("rank") == 0) | asked)
    fields = ["rank", "stream_idx", "resolution", "size_mb", "kind", "is_progressive"]
    best = found.groupBy("video_id").agg(F.max(F.struct(*fields)).alias("_s"))
    return best.select("video_id", *[f"_s.{f}" for f in fields])


def attach_audio(chosen: DataFrame, streams: DataFrame) -> DataFrame:
    """Add ``audio_idx``: the first audio stream, where the choice has no sound."""
    audio = (
        streams.where(F.col("type") == "audio")
        .groupBy("video_id")
        .agg(F.min("stream_idx").alias("_audio"))
    )
    joined = chosen.join(audio, "video_id", "left")
    return joined.withColumn("audio_idx", F.when(~F.col("is_progressive"), F.col("_audio"))).drop("_audio")
