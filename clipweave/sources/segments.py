"""Timed transcript segments, the core fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "STRUCT<text: STRING, start_s: DOUBLE, end_s: DOUBLE>"
FILE_SCHEMA = f"video_id BIGINT, segments ARRAY<{SEGMENT}>"


def explode_segments(nested: DataFrame) -> DataFrame:
    """One row per list entry; the list position becomes ``seg_idx``.

    A null or empty list (a failed transcription) gives zero rows.
    """
    return nested.select("video_id", F.posexplode("segments").alias("seg_idx", "_s")).select(
        "video_id",
        "seg_idx",
        F.col("_s.text").alias("text"),
        F.col("_s.start_s").alias("start_s"),
        F.col("_s.end_s").alias("end_s"),
    )


def read_segments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read transcripts with an explicit schema, no inference pass over the data.

    ``json``: one object per line, ``{"video_id": .., "segments": [..]}``.
    ``parquet``/``orc``: the flat table itself.
    """
    if fmt == "json":
        return explode_segments(spark.read.schema(FILE_SCHEMA).json(path))
    flat = spark.read.format(fmt).load(path)
    return flat.select("video_id", "seg_idx", "text", "start_s", "end_s")
