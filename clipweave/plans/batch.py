"""A whole work list as one job: from items to outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.operators.decisions import settle_attempts
from clipweave.operators.highlights import parse_highlight
from clipweave.operators.items import item_outcomes


def batch_outcomes(
    items: DataFrame,
    videos: DataFrame,
    segments: DataFrame,
    replies: DataFrame,
    decisions: DataFrame | None = None,
) -> DataFrame:
    """``(line_no, item, status, exit_code)`` for every item of a work list.

    ``videos`` is ``(item, video_id, has_audio, duration_s, width, height)`` with one row per
    item that could be fetched; ``replies`` ``(video_id, attempt, response)``;
    ``decisions`` ``(video_id, attempt, decision)``.  Without decisions everything
    is approved.  An item listed twice has two outcomes.
    """
    parsed = parse_highlight(replies, keep=["attempt"])
    if decisions is None:
        asked = parsed.withColumn("decision", F.lit("approve"))
    else:
        asked = parsed.join(decisions.select("video_id", "attempt", "decision"), ["video_id", "attempt"], "left")
    counts = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"))
    stages = (
        items.join(videos, "item", "left")
        .join(counts, "video_id", "left")
        .join(settle_attempts(asked), "video_id", "left")
        .withColumn("has_video", F.col("video_id").isNotNull())
        .withColumn("has_audio", F.coalesce(F.col("has_audio"), F.lit(False)))
    )
    return item_outcomes(stages).select("line_no", "item", "status", "exit_code")
