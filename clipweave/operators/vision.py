"""Frame geometry, faces and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions import clamp, floor_div, trunc_int, vertical_height, vertical_width
from clipweave.operators.ordered import chunk_key, position_chunk

# Fixed values.
SHOWN_SHARE = 0.67
FACE_FRAMES = 30
MIN_FACE = 30
FACE_SHIFT = 60
MIN_CONFIDENCE = 0.3
FACE_CROP_SHARE = 0.9
UNIQUE_FACES = 5
NMS_MIN_CONFIDENCE = 0.01
NMS_TOP = 400
NMS_OVERLAP = 0.45
NMS_KEEP = 200


def _frame(keys: list[str] | None = None) -> Column:
    """One frame of a video (or clip) as a grouping value, so that frames of a hot video spread."""
    return chunk_key(keys or ["video_id"], F.col("frame_no"))


def vertical_dims(videos: DataFrame) -> DataFrame:
    """Add ``vertical_w``, ``vertical_h`` and ``dims_status`` (``ok`` or ``too_narrow``)."""
    w = vertical_width(F.col("height"))
    return videos.select(
        "*",
        w.alias("vertical_w"),
        vertical_height(F.col("height")).alias("vertical_h"),
        F.when(F.col("width") < w, "too_narrow").otherwise("ok").alias("dims_status"),
    )


def screen_scale(videos: DataFrame) -> DataFrame:
    """Scaled size and letterbox offset for videos without a face.

    About two thirds of the width fill the vertical frame; if that would be too
    high, the height fills it.  Adds ``scale``, ``scaled_w``, ``scaled_h``,
    ``offset_y`` and ``max_x``, the largest crop offset.
    """
    dims = vertical_dims(videos)
    w, h, vw, vh = (F.col(c).cast("double") for c in ("width", "height", "vertical_w", "vertical_h"))
    by_width = vw / (w * F.lit(SHOWN_SHARE))
    scale = F.when(trunc_int(h * by_width) > vh, vh / h).otherwise(by_width)
    sized = dims.withColumn("scale", scale).select(
        "*",
        trunc_int(F.col("width") * F.col("scale")).alias("scaled_w"),
        trunc_int(F.col("height") * F.col("scale")).alias("scaled_h"),
    )
    room = F.col("vertical_h") - F.col("scaled_h")
    return sized.select(
        "*",
        F.when(room > 0, floor_div(room, 2)).otherwise(F.lit(0)).alias("offset_y"),
        F.greatest(F.lit(0), F.col("scaled_w") - F.col("vertical_w")).alias("max_x"),
    )


def scale_boxes(raw: DataFrame, videos: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Relative boxes above a confidence to whole pixels of their video."""
    sizes = videos.select("video_id", "width", "height")
    kept = raw.where(F.col("confidence") > min_confidence).join(sizes, "video_id")
    return kept.select(
        "video_id",
        "frame_no",
        "det_idx",
        "confidence",
        trunc_int(F.col("rx") * F.col("width")).alias("x"),
        trunc_int(F.col("ry") * F.col("height")).alias("y"),
        trunc_int(F.col("rx1") * F.col("width")).alias("x1"),
        trunc_int(F.col("ry1") * F.col("height")).alias("y1"),
    )


def clip_detections(
    clips: DataFrame, detections: DataFrame, videos: DataFrame, n: int = FACE_FRAMES
) -> DataFrame:
    """Detections in the first ``n`` frames of each clip, with ``clip_idx`` and frames counted from its start.

    Clips and detections meet on the video and a block of ``n`` frames; a clip touches at most two
    blocks, so a hot video spreads and no detection meets a clip that is far from it.
    """
    begins = F.floor(F.col("start_s") * F.col("fps"))
    block = lambda frame: F.floor(frame / F.lit(n))
    starts = clips.join(videos.select("video_id", "fps"), "video_id").select(
        "video_id", "clip_idx", begins.alias("_begin")
    )
    blocks = F.array_distinct(F.array(block(F.col("_begin")), block(F.col("_begin") + n - 1)))
    wanted = starts.withColumn("_block", F.explode(blocks))
    met = detections.withColumn("_block", block(F.col("frame_no"))).join(wanted, ["video_id", "_block"])
    inside = F.col("frame_no").between(F.col("_begin"), F.col("_begin") + n - 1)
    shifted = met.where(inside).withColumn("frame_no", (F.col("frame_no") - F.col("_begin")).cast("int"))
    return shifted.drop("_block", "_begin")


def largest_face(
    detections: DataFrame, n: int = FACE_FRAMES, min_size: int = MIN_FACE, keys: tuple[str, ...] = ("video_id",)
) -> DataFrame:
    """The largest face of each of the first ``n`` frames; ties go to the first found.

    Frames are those of a video, or of a clip if ``keys`` also names ``clip_idx``.
    """
    w, h = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    faces = detections.where((F.col("frame_no") < n) & (w >= min_size) & (h >= min_size))
    best = F.max(
        F.struct(
            (w.cast("long") * h).alias("area"),
            (-F.col("det_idx")).alias("_first"),
            "x",
            "y",
            w.alias("w"),
            h.alias("h"),
        )
    )
    return (
        faces.groupBy(_frame(list(keys)).alias("_part"))
        .agg(best.alias("_f"))
        .select(*[f"_part.{k}" for k in keys], F.col("_part.chunk").alias("frame_no"), "_f.x", "_f.y", "_f.w", "_f.h", "_f.area")
    )


def static_crop(faces: DataFrame, videos: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``(video_id, mode, x_start)``: crop centred on the upper median face.

    With ``clip_idx`` among the ``keys``, ``videos`` has a row per clip and so has the result.
    ``faces`` has at most one row per leading frame, so the sorted list is short.
    Videos without a face are in ``motion`` mode, too narrow ones in ``reject``.
    """
    centre = F.col("x") + floor_div(F.col("w"), 2)
    centres = F.sort_array(F.collect_list(centre))
    middle = F.get(F.col("_c"), F.floor(F.size("_c") / 2).cast("int"))
    medians = (
        faces.groupBy(*keys)
        .agg(centres.alias("_c"))
        .select(*keys, (middle + FACE_SHIFT).alias("_x"))
    )
    dims = vertical_dims(videos).select(*keys, "width", "vertical_w", "dims_status")
    vw = F.col("vertical_w")
    placed = clamp(F.col("_x") - floor_div(vw, 2), 0, F.col("width") - vw)
    usable = F.col("dims_status") == "ok"
    return dims.join(medians, list(keys), "left").select(
        *keys,
        F.when(~usable, "reject").when(F.col("_x").isNull(), "motion").otherwise("face").alias("mode"),
        F.when(usable, F.when(F.col("_x").isNull(), 0).otherwise(placed)).alias("x_start"),
    )


def unique_faces(detections: DataFrame, k: int = UNIQUE_FACES) -> DataFrame:
    """Distinct boxes in first-seen order until ``k`` are known.

    The count is tested between frames, so the frame that reaches ``k`` is kept
    whole: a box stays if fewer than ``k`` boxes appear in earlier frames, which is
    what ``rank`` by frame says.  The limit is applied before the shuffle as well.
    """
    box = [
        F.col("x"),
        F.col("y"),
        (F.col("x1") - F.col("x")).alias("w"),
        (F.col("y1") - F.col("y")).alias("h"),
    ]
    seen = (
        detections.select("video_id", *box, F.struct("frame_no", "det_idx").alias("_at"))
        .groupBy(F.struct("video_id", "x", "y", "w", "h").alias("_box"))
        .agg(F.min("_at").alias("_at"))
        .select("_box.*", "_at")
        .withColumn("first_frame", F.col("_at.frame_no"))
    )
    per_video = Window.partitionBy("video_id")
    kept = seen.withColumn("_rank", F.rank().over(per_video.orderBy("first_frame"))).where(
        F.col("_rank") <= k
    )
    number = F.row_number().over(per_video.orderBy("_at")) - 1
    return kept.select("video_id", number.alias("face_no"), "first_frame", "x", "y", "w", "h")


def face_windows(faces: DataFrame, videos: DataFrame) -> DataFrame:
    """Crop window of each face, centred on it and cut to the frame."""
    sized = faces.join(videos.select("video_id", "width", "height"), "video_id").withColumn(
        "target_h", trunc_int(F.col("height") * F.lit(FACE_CROP_SHARE))
    )
    sized = sized.withColumn("target_w", trunc_int(F.col("target_h") * F.lit(9 / 16)))

    def start(at: str, size: str, target: str) -> Column:
        return F.greatest(F.lit(0), F.col(at) + floor_div(F.col(size) - F.col(target), 2))

    placed = sized.withColumn("crop_x", start("x", "w", "target_w")).withColumn(
        "crop_y", start("y", "h", "target_h")
    )
    return placed.select(
        "video_id",
        "face_no",
        "target_w",
        "target_h",
        "crop_x",
        "crop_y",
        F.least(F.col("crop_x") + F.col("target_w"), F.col("width")).alias("crop_x2"),
        F.least(F.col("crop_y") + F.col("target_h"), F.col("height")).alias("crop_y2"),
    )


def face_crop_windows(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Every frame with every face window of its video, in output order.

    ``windows`` comes from ``face_windows`` over ``unique_faces``: a handful of rows
    per video, so this is a lookup join whose only large side is ``frames``.
    """
    return frames.select("video_id", "frame_no").join(windows, "video_id")


def face_crop_ranges(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Each face window of a video once, with the frames it holds for: ``first_frame``, ``last_frame``, ``n_frames``.

    The compact form of ``face_crop_windows``: a window does not move, so its rows differ in the frame only.
    Frames are summed before the shuffle, in one row per video and chunk; nothing is joined per frame.
    """
    part = chunk_key(["video_id"], position_chunk("frame_no"))
    ends = [F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count(F.lit(1)).alias("n_frames")]
    chunks = frames.groupBy(part.alias("_part")).agg(*ends).select("_part.video_id", "first_frame", "last_frame", "n_frames")
    whole = chunks.groupBy("video_id").agg(
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.sum("n_frames").alias("n_frames")
    )
    return windows.join(whole, "video_id").select(
        "video_id", "face_no", "first_frame", "last_frame", "n_frames", "crop_x", "crop_y", "crop_x2", "crop_y2"
    )


def sample_frames(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames looked at for motion: one per ``int(fps)`` frames, numbered from 0."""
    step = videos.select("video_id", trunc_int(F.col("fps")).alias("_step")).where(F.col("_step") > 0)
    return (
        frames.join(step, "video_id")
        .where(F.pmod(F.col("frame_no"), F.col("_step")) == 0)
        .select("video_id", "frame_no", F.floor(F.col("frame_no") / F.col("_step")).cast("int").alias("sample_no"))
    )


def _overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 for empty boxes."""
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x"], b["x"])).cast("double")
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y"], b["y"])).cast("double")
    size = lambda r: (r["x1"] - r["x"]).cast("double") * (r["y1"] - r["y"]).cast("double")
    union = size(a) + size(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def nms(
    detections: DataFrame,
    min_confidence: float = NMS_MIN_CONFIDENCE,
    top: int = NMS_TOP,
    max_overlap: float = NMS_OVERLAP,
    keep: int = NMS_KEEP,
) -> DataFrame:
    """Per frame, drop boxes that overlap a better kept box too much.

    The detector's own limits bound each group: the ``top`` best boxes enter, found
    with a limit that also runs before the shuffle, and ``keep`` leave.
    """
    order = Window.partitionBy("_part").orderBy(F.col("confidence").desc(), "det_idx")
    entered = (
        detections.where(F.col("confidence") > min_confidence)
        .withColumn("_part", _frame())
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= top)
    )
    box = F.struct("_n", "det_idx", "confidence", "x", "y", "x1", "y1")
    sorted_boxes = entered.groupBy("_part").agg(F.array_sort(F.collect_list(box)).alias("_b"))
    kept = F.aggregate(
        "_b",
        F.slice("_b", 1, 0),
        lambda acc, b: F.when(F.exists(acc, lambda k: _overlap(k, b) > max_overlap), acc).otherwise(
            F.array_append(acc, b)
        ),
    )
    return sorted_boxes.select(
        "_part.video_id", F.col("_part.chunk").alias("frame_no"), F.posexplode(F.slice(kept, 1, keep)).alias("rank", "_k")
    ).select(
        "video_id", "frame_no", "rank", "_k.det_idx", "_k.confidence", "_k.x", "_k.y", "_k.x1", "_k.y1"
    )
