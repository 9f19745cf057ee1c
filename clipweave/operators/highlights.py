"""From model replies to clip ranges: parse, gate, clamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import compute_once

# Times are read as text: a quoted number is as good as a bare one.
REPLY = "STRUCT<start: STRING, content: STRING, `end`: STRING>"
END_MARGIN_S = 0.1


def parse_highlight(
    replies: DataFrame, column: str = "response", keep: Sequence[str] = ()
) -> DataFrame:
    """``(video_id, status, start_s, stop_s, content)`` from a JSON reply.

    Statuses, in the order they are tested: ``empty``, ``bad_structure``,
    ``unparseable``, ``negative``, ``end_not_after_start``, ``ok``.  Times are cut
    to whole seconds first.  A list holding one object is read as that object.
    Failed rows stay in the table with null times.  ``keep`` names columns to carry.
    """
    raw = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    read = compute_once(replies.select("video_id", *keep, raw.alias("_raw")), "_r", _reply(F.col("_raw")))
    start, stop = _seconds(F.col("_r.start")), _seconds(F.col("_r.end"))
    missing = F.col("_r.start").isNull() | F.col("_r.end").isNull() | F.col("_r.content").isNull()
    status = (
        F.when(F.col("_raw").isNull() | F.col("_raw").isin("", "null"), "empty")
        .when(missing, "bad_structure")
        .when(start.isNull() | stop.isNull(), "unparseable")
        .when((start < 0) | (stop < 0), "negative")
        .when(stop <= start, "end_not_after_start")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return compute_once(read, "status", status).select(
        "video_id",
        *keep,
        "status",
        F.when(ok, start).alias("start_s"),
        F.when(ok, stop).alias("stop_s"),
        F.when(ok, F.col("_r.content")).alias("content"),
    )


def gate_highlights(highlights: DataFrame) -> DataFrame:
    """Highlights that may be cut: both times positive and in order.

    A start of exactly 0 parses fine but does not pass here.
    """
    return highlights.where(passes_gate(F.col("start_s"), F.col("stop_s")))


def passes_gate(start: Column, stop: Column) -> Column:
    """May this range be cut?  False for missing times."""
    return F.coalesce((start > 0) & (stop > 0) & (stop > start), F.lit(False))


def clamp_clip(highlights: DataFrame, videos: DataFrame) -> DataFrame:
    """Clip range in source time; the end stays 0.1 s before the end of the video.

    A start beyond that point has no clip: status ``out_of_range``.  A range that does
    not pass the gate has status ``bad_highlight``.
    """
    limit = F.col("_length") - F.lit(END_MARGIN_S)
    lengths = videos.select("video_id", F.col("duration_s").alias("_length"))
    end = F.least(F.col("stop_s").cast("double"), limit)
    return highlights.join(lengths, "video_id").select(
        "video_id",
        "start_s",
        end.alias("end_s"),
        (end - F.col("start_s")).alias("clip_s"),
        F.when(~passes_gate(F.col("start_s"), F.col("stop_s")), "bad_highlight")
        .when(F.col("start_s") >= limit, "out_of_range")
        .otherwise("ok")
        .alias("clip_status"),
    )


def _reply(raw: Column) -> Column:
    listed = F.from_json(raw, f"ARRAY<{REPLY}>")
    single = F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))
    return F.when(raw.startswith("["), single).otherwise(F.from_json(raw, REPLY))


def _seconds(text: Column) -> Column:
    return text.try_cast("double").try_cast("int")
