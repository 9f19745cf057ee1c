"""Who speaks in each frame: faces matched with speech by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.functions import floor_div
from clipweave.operators.ordered import chunk_key, fill_forward, position_chunk


def lip_distance(boxes: DataFrame) -> DataFrame:
    """Add ``lip``: distance between the lower third line and the lower edge of a box."""
    height = F.col("y1") - F.col("y")
    lip = F.abs(F.col("y") + floor_div(height * 2, 3) - F.col("y1"))
    return boxes.withColumn("lip", lip)


def zip_audio(frames: DataFrame, audio_frames: DataFrame) -> DataFrame:
    """The i-th video frame with the i-th audio frame; the shorter side ends the pairs.

    Positions have no gaps on either side, so this is an inner join on position.
    """
    audio = audio_frames.select("video_id", "frame_no", "is_speech")
    return frames.select("video_id", "frame_no").join(audio, ["video_id", "frame_no"])


def active_speaker(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """The face with the largest lip distance in each frame; ties go to the first found.

    ``frames`` comes from ``zip_audio``; a frame without a face has a null ``box``.
    ``is_active`` says that the face is shown as speaking.
    """
    box = F.struct("x", "y", "x1", "y1")
    best = (
        lip_distance(boxes)
        .select(
            chunk_key(["video_id"], F.col("frame_no")).alias("_part"),
            F.struct("lip", (-F.col("det_idx")).alias("_first"), box.alias("box")).alias("_s"),
        )
        .groupBy("_part")
        .agg(F.max("_s").alias("_s"))
        .select("_part.video_id", F.col("_part.chunk").alias("frame_no"), "_s")
    )
    return frames.join(best, ["video_id", "frame_no"], "left").select(
        "video_id",
        "frame_no",
        F.col("_s.lip").alias("lip"),
        F.col("_s.box").alias("box"),
        (F.col("_s").isNotNull() & F.col("is_speech")).alias("is_active"),
    )


def fill_track(track: DataFrame) -> DataFrame:
    """Replace missing boxes by the last known one; null before the first."""
    filled = fill_forward(
        track, ["video_id"], position_chunk("frame_no"), [F.col("frame_no")], F.col("box"), "_box"
    )
    return filled.drop("box").withColumnRenamed("_box", "box")
