"""Whole plans: from segments and model replies to a clip manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import output_name, session_key
from clipweave.operators.captions import caption_counts
from clipweave.operators.highlights import clamp_clip, gate_highlights, parse_highlight, passes_gate
from clipweave.operators.motion import crop_ranges, motion_centroid
from clipweave.operators.ordered import dense_index
from clipweave.operators.spans import all_spans, candidate_spans
from clipweave.operators.vision import clip_detections, largest_face, static_crop, vertical_dims
from clipweave.session import ensure_checkpoint_dir
from clipweave.sources.manifest import temp_names


def single_clips(responses: DataFrame, videos: DataFrame) -> DataFrame:
    """``(video_id, clip_idx, start_s, end_s, clip_s)``: one clip per usable reply."""
    ranges = clamp_clip(gate_highlights(parse_highlight(responses)), videos)
    return ranges.where(F.col("clip_status") == "ok").select(
        "video_id", F.lit(0).alias("clip_idx"), "start_s", "end_s", "clip_s"
    )


def many_clips(spans: DataFrame, score: Column, videos: DataFrame, single: bool = False) -> DataFrame:
    """Clips for every good span of a video, numbered in time order, or for the best only.

    Nothing is dropped: ``clip_status`` is ``ok``, ``bad_highlight`` or ``out_of_range``.
    Spans that do not pass the gate rank below all others, so they push none out.
    """
    cut = passes_gate(F.col("start_s").cast("int"), F.col("end_s").cast("int"))
    picked = all_spans(spans, F.when(cut, score.cast("double")).otherwise(float("-inf")), single)
    whole = picked.select(
        "video_id",
        F.col("start_s").cast("int").alias("start_s"),
        F.col("end_s").cast("int").alias("stop_s"),
    )
    ranges = clamp_clip(whole, videos)
    day = F.floor(F.col("start_s") / F.lit(86400))
    numbered = dense_index(ranges, ["video_id"], day, [F.col("start_s")], "_n")
    return numbered.select(
        "video_id", F.col("_n").cast("int").alias("clip_idx"), "start_s", "end_s", "clip_s", "clip_status"
    )


def clip_crops(clips: DataFrame, detections: DataFrame, videos: DataFrame) -> DataFrame:
    """``(video_id, clip_idx, mode, x_start)``: the crop of each clip, from the first frames of that clip."""
    keys = ("video_id", "clip_idx")
    sized = clips.select(*keys).join(videos.select("video_id", "width", "height"), "video_id")
    return static_crop(largest_face(clip_detections(clips, detections, videos), keys=keys), sized, keys)


def clip_crop_ranges(clips: DataFrame, detections: DataFrame, motion: DataFrame, videos: DataFrame) -> DataFrame:
    """The crop of each clip as ranges of frames: fixed on a face, else following motion; see ``crop_ranges``."""
    return crop_ranges(clips, clip_crops(clips, detections, videos), motion_centroid(motion), videos)


def _crop_plans(ranges: DataFrame) -> DataFrame:
    """Ranges as one line per clip: ``first-last@x`` joined by semicolons; a clip shifts at most once a second."""
    piece = F.format_string("%d-%d@%d", "first_frame", "last_frame", "crop_x")
    ordered = F.array_sort(F.collect_list(F.struct("range_no", piece.alias("piece"))))
    return ranges.groupBy(F.struct("video_id", "clip_idx").alias("_clip")).agg(ordered.alias("_p")).select(
        "_clip.*", F.size("_p").alias("n_ranges"), F.array_join(F.transform("_p", lambda x: x["piece"]), ";").alias("crop_plan")
    )


def manifest(
    clips: DataFrame, videos: DataFrame, segments: DataFrame, detections: DataFrame, motion: DataFrame
) -> DataFrame:
    """One row per clip: source, range, frame size, crop plan, number of captions, file names, status.

    ``clips`` is ``(video_id, clip_idx, start_s, end_s, clip_s[, clip_status])``, one or many per video; ``videos`` has
    ``title``, ``source``, ``width``, ``height`` and ``fps``.  A clip whose ``clip_status`` is not ``ok`` keeps a row with that
    status and no plan; so does one of a frame narrower than its crop, as ``too_narrow``.  Every run has its own
    key, made of video and clip, in the names of its files.

    The clips are few and used in every branch, so they are checkpointed.
    """
    ensure_checkpoint_dir(videos.sparkSession)
    keys = ["video_id", "clip_idx"]
    if "clip_status" not in clips.columns:
        clips = clips.withColumn("clip_status", F.lit("ok"))
    clips = clips.checkpoint()
    cut = clips.where("clip_status = 'ok'")
    crops = clip_crops(cut, detections, videos).checkpoint()
    ranges = crop_ranges(cut, crops, motion_centroid(motion), videos)
    dims = vertical_dims(videos).select("video_id", "title", "source", "vertical_w", "vertical_h")
    named = (
        clips.join(dims, "video_id")
        .join(crops, keys, "left")
        .join(_crop_plans(ranges), keys, "left")
        .join(caption_counts(cut, segments), keys, "left")
        .withColumn("session", session_key(*keys))
    )
    status = F.when(F.col("clip_status") != "ok", F.col("clip_status")).when(F.col("mode") == "reject", "too_narrow").otherwise("planned")
    return named.select(
        *keys,
        "source",
        "start_s",
        "end_s",
        "vertical_w",
        "vertical_h",
        "mode",
        "x_start",
        F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"),
        F.coalesce("crop_plan", F.lit("")).alias("crop_plan"),
        F.coalesce("n_captions", F.lit(0)).alias("n_captions"),
        output_name("title", F.col("session")).alias("output"),
        *[c.alias(n) for n, c in temp_names().items()],
        status.alias("status"),
    )


def clip_manifest(
    videos: DataFrame, segments: DataFrame, responses: DataFrame, detections: DataFrame, motion: DataFrame
) -> DataFrame:
    """``manifest`` of one clip per usable reply."""
    return manifest(single_clips(responses, videos), videos, segments, detections, motion)


def many_clip_manifest(
    videos: DataFrame, segments: DataFrame, score: Column, detections: DataFrame, motion: DataFrame
) -> DataFrame:
    """``manifest`` of every good span of each video."""
    return manifest(many_clips(candidate_spans(segments), score, videos), videos, segments, detections, motion)
