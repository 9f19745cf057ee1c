"""Captions and text overlays for clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import strip, trunc_int, wrap_text

# Caption style.
CAPTION_COLOR = "#2699ff"
CAPTION_STROKE_COLOR = "black"
CAPTION_STROKE_WIDTH = 2
CAPTION_FONT = "Franklin-Gothic"
CAPTION_FONT_SHARE = 0.065
CAPTION_SIDE_ROOM = 100
CAPTION_BOTTOM_ROOM = 100

# Overlay style before overrides.
OVERLAY_DEFAULTS = {
    "font": "DejaVu-Sans-Bold",
    "fontsize": "15",
    "color": "white",
    "bg_opacity": "0.7",
    "stroke_color": "black",
    "stroke_width": "1",
    "position": "center,center",
    "line_height": "1.2",
    "animation_style": "none",
}
OVERLAY_MIN_S = 0.5
OVERLAY_WIDTH_SHARE = 0.8

# Found at the first letter; stripping looks at all of them.
NOT_BLANK = r"(?U)\S"

BUCKET_S = 64.0
_ROUNDING = 1e-6


def _buckets(low: Column, high: Column) -> Column:
    """Numbers of all time buckets a range touches."""
    return F.sequence(F.floor(low / BUCKET_S), F.floor(high / BUCKET_S))


def _met(clips: DataFrame, segments: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Segments in the time buckets of each clip of their video, with ``columns`` of the segment; ``_hit``: it overlaps.

    Both sides are placed in fixed time buckets and joined on video and bucket: a
    very long video is spread over its buckets, and only neighbours in time meet.
    A pair that shares several buckets overlaps in the first one only.
    """
    s0 = F.least("start_s", F.greatest("start_s", "end_s"))
    s1 = F.greatest("start_s", "end_s")
    seg = segments.select(
        "video_id", "seg_idx", "start_s", "end_s", *columns, F.explode(_buckets(s0, s1)).alias("_b")
    )
    clip_end = F.col("start_s") + F.col("clip_s") + F.lit(_ROUNDING)
    cut = clips.select(
        "video_id",
        "clip_idx",
        F.col("start_s").alias("_from"),
        F.col("clip_s").alias("_length"),
        F.explode(_buckets(F.col("start_s"), clip_end)).alias("_b"),
    )
    shift0, shift1 = F.col("start_s") - F.col("_from"), F.col("end_s") - F.col("_from")
    first_shared = F.floor(F.greatest("start_s", "_from") / BUCKET_S)
    hit = (shift1 > 0) & (shift0 < F.col("_length")) & (F.col("_b") == first_shared)
    return cut.join(seg, ["video_id", "_b"], how).withColumn("_hit", F.coalesce(hit, F.lit(False)))


def clip_captions(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Captions of every clip in clip time.

    ``clips`` is ``(video_id, clip_idx, start_s, clip_s)``.  Segments that overlap
    the clip strictly are shifted and cut to ``[0, clip_s]``; text is stripped and
    blank captions are dropped.  A clip that no segment overlaps keeps one row
    with status ``no_overlap``; one whose segments are all blank has no row.
    """
    found = F.struct("seg_idx", "text", "start_s", "end_s")
    per_clip = (
        _met(clips, segments, "text", how="left")
        .groupBy(F.struct("video_id", "clip_idx", "_from", "_length").alias("_clip"))
        .agg(F.collect_list(F.when(F.col("_hit"), found)).alias("_found"))
    )
    shown = per_clip.select("_clip.*", F.explode_outer("_found").alias("_s")).select(
        "video_id", "clip_idx", "_from", "_length", "_s.seg_idx", strip("_s.text").alias("text"), "_s.start_s", "_s.end_s"
    )
    none = F.col("seg_idx").isNull()
    return shown.where(none | (F.col("text") != "")).select(
        "video_id",
        "clip_idx",
        "seg_idx",
        "text",
        F.when(~none, F.greatest(F.lit(0.0), F.col("start_s") - F.col("_from"))).alias("start_s"),
        F.when(~none, F.least(F.col("_length"), F.col("end_s") - F.col("_from"))).alias("end_s"),
        F.when(none, "no_overlap").otherwise("caption").alias("status"),
    )


def caption_counts(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """``(video_id, clip_idx, n_captions)`` for every clip; carries a flag for blank segments, not the text."""
    flagged = segments.select("video_id", "seg_idx", "start_s", "end_s", F.col("text").rlike(NOT_BLANK).alias("_shown"))
    counted = F.count(F.when(F.col("_hit") & F.col("_shown"), 1)).alias("n_captions")
    met = _met(clips, flagged, "_shown", how="left")
    return met.groupBy(F.struct("video_id", "clip_idx").alias("_clip")).agg(counted).select("_clip.*", "n_captions")


def caption_layout(captions: DataFrame) -> DataFrame:
    """Size, place and duration of each caption.

    Needs the frame ``width`` and ``height``; ``text_h`` is the height the renderer
    measured, and the vertical place is null where it is unknown.
    """
    return captions.where(F.col("text").isNotNull()).select(
        "*",
        trunc_int(F.col("height") * F.lit(CAPTION_FONT_SHARE)).alias("font_size"),
        (F.col("width") - CAPTION_SIDE_ROOM).alias("box_width"),
        F.lit(CAPTION_COLOR).alias("color"),
        F.lit(CAPTION_STROKE_COLOR).alias("stroke_color"),
        F.lit(CAPTION_STROKE_WIDTH).alias("stroke_width"),
        F.lit(CAPTION_FONT).alias("font"),
        F.lit("center").alias("pos_x"),
        (F.col("height") - F.col("text_h") - CAPTION_BOTTOM_ROOM).alias("pos_y"),
        (F.col("end_s") - F.col("start_s")).alias("shown_s"),
    )


def overlay_plan(segments: DataFrame, max_chars: int = 35) -> DataFrame:
    """Overlay text and colour of segments shown for half a second or more.

    The colour follows the position among all segments, short ones included.
    """
    shown = segments.where(~(F.col("end_s") - F.col("start_s") < OVERLAY_MIN_S))
    color = F.when(F.pmod(F.col("seg_idx"), F.lit(3)) == 0, "white").otherwise("yellow")
    return shown.select(
        "video_id",
        "seg_idx",
        wrap_text("text", max_chars).alias("lines"),
        "start_s",
        "end_s",
        color.alias("color"),
    )


def default_style() -> Column:
    return F.create_map(*[F.lit(x) for kv in OVERLAY_DEFAULTS.items() for x in kv])


def merge_style(base: Column, override: Column) -> Column:
    """Two style maps as one; where both have a key the override wins."""
    override = F.coalesce(override, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def overlay_style(overlays: DataFrame, style: str = "style") -> DataFrame:
    """Box width, fade and vertical place from the merged style of each overlay.

    Needs ``width``, ``height``, ``text_h``, ``start_s`` and ``end_s``.  A fade without
    a length, or a place at the bottom without a margin, cannot be drawn:
    ``style_status`` is then ``missing_key``, otherwise ``ok``.
    """
    value = lambda key: F.col(style)[key]
    bare = lambda kind, wanted, key: (value(kind) == wanted) & value(key).isNull()
    broken = bare("animation_style", "fade", "fade_duration") | bare("position", "center,bottom", "margin_bottom")
    shown = F.col("end_s") - F.col("start_s")
    fade = value("fade_duration").try_cast("double")
    y = F.col("height") - value("margin_bottom").try_cast("int") - F.col("text_h")
    own_width = trunc_int(F.col("width") * F.lit(OVERLAY_WIDTH_SHARE))
    return overlays.select(
        "*",
        F.coalesce(value("max_width").try_cast("int"), own_width).alias("box_width"),
        F.when((value("animation_style") == "fade") & (fade > 0), F.least(fade, shown / 2)).alias("fade_s"),
        F.when(value("position") == "center,bottom", y).alias("pos_y"),
        shown.alias("shown_s"),
        F.when(broken, "missing_key").otherwise("ok").alias("style_status"),
    )
