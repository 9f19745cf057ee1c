"""Work-list operators: routing, resume state, stop rules and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import vertical_width
from clipweave.operators.highlights import END_MARGIN_S, passes_gate
from clipweave.operators.ordered import position_chunk, running_sum


def route_inputs(items: DataFrame, files: DataFrame) -> DataFrame:
    """Mark each item ``file`` if it is in the listing ``files(path)``, else ``url``.

    The listing is made distinct before the join, so no item is duplicated, and a
    repeated item only makes the probe side skewed, which adaptive execution splits.
    """
    known = files.select(F.col("path").alias("item")).distinct().withColumn("_known", F.lit(True))
    return items.join(known, "item", "left").select(
        *[F.col(c) for c in items.columns],
        F.when(F.col("_known"), "file").otherwise("url").alias("route"),
    )


def pending_transcription(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Videos that have no transcript yet."""
    return videos.join(segments.select("video_id").distinct(), "video_id", "left_anti")


def pending_items(items: DataFrame, state: DataFrame, retry_failures: bool = False) -> DataFrame:
    """Items still to run: never those that succeeded, failed ones only on request.

    ``state`` is ``(item_id, status)`` with status ``success``, ``failed`` or other.
    """
    closed = ["success"] if retry_failures else ["success", "failed"]
    done = state.where(F.col("status").isin(*closed)).select("item_id").distinct()
    return items.join(done, "item_id", "left_anti")


def take_until(results: DataFrame, n: int, order: str = "line_no", success: str = "success") -> DataFrame:
    """Rows of the queue, in order, up to and including the ``n``-th success.

    ``order`` is the 0-based queue position.  Chunk totals find how far the queue
    is needed; nothing is sorted globally.
    """
    counted = running_sum(
        results,
        [],
        position_chunk(order),
        [F.col(order)],
        F.when(F.col(success), 1).otherwise(0),
        "_successes_before",
        inclusive=False,
    )
    return counted.where(F.col("_successes_before") < n).select(*results.columns)


def discover(
    listing: DataFrame, min_s: float, max_s: float, sorts: Sequence[str] = ("view_count", "upload_date")
) -> DataFrame:
    """Listing entries of a wanted length, highest values of the sort keys first."""
    kept = listing.where(F.col("duration_s").between(min_s, max_s))
    return kept.orderBy(*[F.col(s).desc() for s in sorts], F.col("url"))


# Exit code of a run that ends in each status.
EXIT_CODES = {
    "no_video": 0,
    "no_audio": 0,
    "no_transcript": 0,
    "highlight_failed": 1,
    "cancelled": 0,
    "crashed": 1,
    "bad_highlight": 0,
    "out_of_range": 1,
    "too_narrow": 1,
    "success": 0,
}


def item_outcomes(stages: DataFrame) -> DataFrame:
    """Status and exit code of every item: the first stage that stopped it.

    ``stages`` needs ``has_video``, ``has_audio``, ``n_segments``,
    ``highlight_ok``, ``decision`` (approve, cancel, regenerate_failed),
    ``start_s``, ``stop_s``, ``duration_s``, ``width`` and ``height``.  A frame that is
    narrower than its vertical crop leaves no cropped file, and the run fails on it.
    """
    start, stop = F.col("start_s"), F.col("stop_s")
    rules = [
        (~F.col("has_video"), "no_video"),
        (~F.col("has_audio"), "no_audio"),
        (F.coalesce(F.col("n_segments"), F.lit(0)) == 0, "no_transcript"),
        (~F.coalesce(F.col("highlight_ok"), F.lit(False)), "highlight_failed"),
        (F.col("decision") == "cancel", "cancelled"),
        (F.col("decision") == "regenerate_failed", "crashed"),
        (~passes_gate(start, stop), "bad_highlight"),
        (start >= F.col("duration_s") - F.lit(END_MARGIN_S), "out_of_range"),
        (F.col("width") < vertical_width(F.col("height")), "too_narrow"),
    ]
    status = _first_true(rules, "success")
    codes = F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])
    return stages.withColumn("status", status).withColumn("exit_code", codes[F.col("status")])


def outcome_funnel(outcomes: DataFrame) -> DataFrame:
    """Number of items per status and exit code."""
    return outcomes.groupBy("status", "exit_code").agg(F.count(F.lit(1)).alias("n_items"))


def _first_true(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    chain = None
    for condition, label in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain.otherwise(default)
