"""Crop offset that follows motion: centroid per sample, smoothing, crop per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions import clamp, floor_div, trunc_int
from clipweave.operators.ordered import chunk_key, fill_forward, position_chunk
from clipweave.operators.vision import screen_scale
from clipweave.session import ensure_checkpoint_dir

# Fixed values.
MOTION_THRESHOLD = 2.0
KEEP_SHARE = 0.90
NEW_SHARE = 0.10

MICRO = 1_000_000
SAMPLE_CHUNK = 1024
FAN = 1024
FRAME_SAMPLES = 512


def motion_centroid(motion: DataFrame, threshold: float = MOTION_THRESHOLD) -> DataFrame:
    """``(video_id, sample_no, centroid_x)``: mean column weighted by motion above a threshold.

    Null where nothing moves enough.  Magnitudes are rounded to whole millionths
    and summed as integers: exact, so the result does not depend on how rows were
    split, and pixels collapse to one row per sample before the shuffle.
    """
    magnitude = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    weight = F.when(magnitude > threshold, F.floor(magnitude * MICRO + F.lit(0.5)).cast("long"))
    part = chunk_key(["video_id"], F.col("sample_no")).alias("_part")
    weighed = motion.select(part, F.col("x").cast("long").alias("x"), weight.alias("_w"))
    sums = weighed.groupBy("_part").agg(
        F.sum(F.col("x") * F.col("_w")).alias("_xw"), F.sum("_w").alias("_w")
    )
    mean = F.col("_xw").cast("double") / F.col("_w").cast("double")
    return sums.select("_part.video_id", F.col("_part.chunk").alias("sample_no"), trunc_int(mean).alias("centroid_x"))


def step(state: Column, target: Column) -> Column:
    """One smoothing step; truncation makes a dead zone, so order and type matter."""
    moved = F.lit(KEEP_SHARE) * state.cast("double") + F.lit(NEW_SHARE) * target.cast("double")
    return F.when(target.isNull(), state).otherwise(moved.cast("int"))


def targets(centroids: DataFrame, videos: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``(video_id, sample_no, target, max_x)``; the first sample never has a target.

    With ``clip_idx`` among the ``keys``, samples are those of a clip and numbered from its start.
    """
    sizes = screen_scale(videos).select("video_id", "vertical_w", "scaled_w", "max_x")
    vw = F.col("vertical_w")
    target = clamp(F.col("centroid_x") - floor_div(vw, 2), 0, F.col("scaled_w") - vw)
    usable = F.col("centroid_x").isNotNull() & (F.col("sample_no") > 0)
    return centroids.join(sizes, "video_id").select(
        *keys, "sample_no", F.when(usable, target).alias("target"), "max_x"
    )


def smooth_track(
    centroids: DataFrame,
    videos: DataFrame,
    chunk: int = SAMPLE_CHUNK,
    fan: int = FAN,
    keys: tuple[str, ...] = ("video_id",),
) -> DataFrame:
    """``(video_id, sample_no, smoothed_x)``: the smoothed offset after every sample.

    With ``clip_idx`` among the ``keys`` (see ``clip_samples``) smoothing starts anew in each clip.

    Each step depends on the one before and truncates, so no linear window gives
    it.  But a step never reorders two states, and it pulls them together: what a
    run of samples does to *any* start state is a short list of (lowest start,
    result) pairs.  Runs are folded to such lists in parallel, the lists are chained
    to find each run's true start, and each run is then replayed on its own.

    The runs, a few bytes per sample, are used three times and are checkpointed, so
    that the motion table below them is read once.
    """
    ensure_checkpoint_dir(centroids.sparkSession)
    runs = (
        targets(centroids, videos, keys)
        .groupBy(chunk_key(keys, position_chunk("sample_no", chunk)).alias("_part"))
        .agg(
            F.array_sort(F.collect_list(F.struct("sample_no", "target"))).alias("_samples"),
            F.first("max_x").alias("_max"),
        )
        .select(*[f"_part.{k}" for k in keys], F.col("_part.chunk").alias("_run"), "_samples", "_max")
        .checkpoint()
    )
    starts = _run_starts(runs.select(*keys, "_run", _run_effect().alias("_effect")), fan, keys)
    states = F.aggregate(
        "_samples",
        F.array("_start"),
        lambda acc, e: F.array_append(acc, step(F.element_at(acc, -1), e["target"])),
    )
    replayed = runs.join(starts, [*keys, "_run"]).select(
        *keys,
        F.inline(
            F.zip_with(
                "_samples",
                F.slice(states, F.lit(2), F.size("_samples")),
                lambda e, s: F.struct(e["sample_no"].alias("sample_no"), s.alias("smoothed_x")),
            )
        ),
    )
    return replayed


def _run_effect() -> Column:
    """The run's (lowest start, result) list; run 0 always starts at offset 0."""
    start = F.when(F.col("_run") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_max")))
    identity = F.transform(start, lambda s: F.struct(s.alias("low"), s.alias("value")))

    def after(acc: Column, e: Column) -> Column:
        move = lambda p: step(p["value"], e["target"])
        first_of_value = F.filter(
            acc, lambda p, i: (i == 0) | (move(p) != move(F.get(acc, F.greatest(i - 1, F.lit(0)))))
        )
        moved = F.transform(first_of_value, lambda p: F.struct(p["low"].alias("low"), move(p).alias("value")))
        return F.when(e["target"].isNull(), acc).otherwise(moved)

    return F.aggregate("_samples", identity, after)


def _apply(effect: Column, state: Column) -> Column:
    return F.array_max(F.filter(effect, lambda p: p["low"] <= state))["value"]


def _run_starts(effects: DataFrame, fan: int, keys: tuple[str, ...]) -> DataFrame:
    """``(video_id, _run, _start)``: chain the effects in two levels of ``fan`` runs.

    With the defaults one row covers a million samples (12 days at one per
    second) and the last level a thousand such rows for a video of 30 years.
    """

    def chain(items: str, start: Column, effect: str) -> Column:
        return F.aggregate(
            items, F.array(start), lambda acc, e: F.array_append(acc, _apply(e[effect], F.element_at(acc, -1)))
        )

    def started(items: str, states: Column, number: str) -> Column:
        return F.inline(
            F.zip_with(
                items,
                F.slice(states, F.lit(1), F.size(items)),
                lambda e, s: F.struct(e[number].alias(number), s.alias("_start")),
            )
        )

    groups = effects.groupBy(*keys, F.floor(F.col("_run") / fan).alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("_run", "_effect"))).alias("_runs")
    )
    whole = F.aggregate(
        F.slice("_runs", F.lit(2), F.size("_runs")),
        F.get("_runs", F.lit(0))["_effect"],
        lambda acc, e: F.transform(
            acc, lambda p: F.struct(p["low"].alias("low"), _apply(e["_effect"], p["value"]).alias("value"))
        ),
    )
    group_starts = (
        groups.select(*keys, "_group", whole.alias("_whole"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_group", "_whole"))).alias("_groups"))
        .select(*keys, started("_groups", chain("_groups", F.lit(0), "_whole"), "_group"))
    )
    return groups.join(group_starts, [*keys, "_group"]).select(
        *keys, started("_runs", chain("_runs", F.col("_start"), "_effect"), "_run")
    )


def crop_per_frame(frames: DataFrame, track: DataFrame, videos: DataFrame) -> DataFrame:
    """Add ``smoothed_x``: the state of the last sample at or before each frame, else 0.

    Frames and states are merged on one line per video and the state is carried
    forward, so samples may be missing and no frame is paired with many states.
    """
    steps = videos.select("video_id", trunc_int(F.col("fps")).alias("_step")).where(F.col("_step") > 0)
    asked = frames.join(steps, "video_id").select(
        "video_id",
        "frame_no",
        F.floor(F.col("frame_no") / F.col("_step")).cast("long").alias("_pos"),
        F.lit(None).cast("int").alias("_x"),
    )
    known = track.select(
        "video_id",
        F.lit(-1).cast(asked.schema["frame_no"].dataType).alias("frame_no"),
        F.col("sample_no").cast("long").alias("_pos"),
        F.col("smoothed_x").alias("_x"),
    )
    merged = fill_forward(
        known.unionByName(asked),
        ["video_id"],
        position_chunk("_pos", FRAME_SAMPLES),
        [F.col("_pos"), F.col("frame_no")],
        F.col("_x"),
        "smoothed_x",
    )
    return merged.where(F.col("frame_no") >= 0).select(
        "video_id", "frame_no", F.coalesce("smoothed_x", F.lit(0)).alias("smoothed_x")
    )


def crop_window(offsets: DataFrame, videos: DataFrame) -> DataFrame:
    """Left and right edge of each crop; one that is cut by the edge moves left."""
    sizes = screen_scale(videos).select("video_id", "vertical_w", "scaled_w")
    right = F.least(F.col("smoothed_x") + F.col("vertical_w"), F.col("scaled_w"))
    cut = right - F.col("smoothed_x") < F.col("vertical_w")
    left = F.when(cut, F.greatest(F.lit(0), right - F.col("vertical_w"))).otherwise(F.col("smoothed_x"))
    return offsets.join(sizes, "video_id").select(
        "video_id", "frame_no", left.alias("crop_x"), right.alias("crop_x2")
    )


CLIP = ("video_id", "clip_idx")


def _clip_frames(clips: DataFrame, videos: DataFrame) -> DataFrame:
    """Clips in frames of their video: first frame, number of frames, sampling step, first and last sample."""
    fps = F.col("fps")
    begin, step = F.floor(F.col("start_s") * fps), trunc_int(fps)
    sized = clips.select(*CLIP, "start_s", "end_s").join(videos.select("video_id", "fps"), "video_id")
    framed = sized.where(step > 0).select(
        *CLIP, begin.alias("_begin"), (F.floor(F.col("end_s") * fps) - begin).alias("_n"), step.alias("_step")
    )
    return framed.where(F.col("_n") > 0).select(
        "*",
        F.ceil(F.col("_begin") / F.col("_step")).alias("_first"),
        F.floor((F.col("_begin") + F.col("_n") - 1) / F.col("_step")).alias("_last"),
    )


def clip_samples(clips: DataFrame, centroids: DataFrame, videos: DataFrame, block: int = SAMPLE_CHUNK) -> DataFrame:
    """``(video_id, clip_idx, sample_no, centroid_x)``: the samples inside each clip, numbered from its start.

    Samples and clips meet on the video and a block of samples, so a hot video spreads over its
    blocks.  A sample in several clips belongs to each of them.
    """
    blocks = F.sequence(position_chunk("_first", block), position_chunk("_last", block))
    wanted = _clip_frames(clips, videos).where("_first <= _last").select(*CLIP, "_first", "_last", F.explode(blocks).alias("_block"))
    known = centroids.select("video_id", "sample_no", "centroid_x", position_chunk("sample_no", block).alias("_block"))
    return (
        known.join(wanted, ["video_id", "_block"])
        .where(F.col("sample_no").between(F.col("_first"), F.col("_last")))
        .select(*CLIP, (F.col("sample_no") - F.col("_first")).cast("int").alias("sample_no"), "centroid_x")
    )


def crop_ranges(clips: DataFrame, crops: DataFrame, centroids: DataFrame, videos: DataFrame) -> DataFrame:
    """The crop of every clip as ranges of its frames that share an offset.

    ``crops`` is ``(video_id, clip_idx, mode, x_start)``.  A clip in ``face`` mode is one range at its fixed offset.
    In ``motion`` mode smoothing starts anew with the clip, at offset 0; frames keep the offset of the last
    sample before them, and a range begins where the offset changes.  A motion clip without
    samples is one range at 0; a rejected clip has none.  So a clip has a row per shift of its crop, not
    one per frame, and no frame is paired with a sample.

    Returns video_id, clip_idx, range_no, mode, first_frame, last_frame (from the clip's start), crop_x, crop_x2.
    Offsets are in pixels of the scaled frame in motion mode, of the source frame in face mode.
    """
    framed = _clip_frames(clips, videos).join(crops.where("mode <> 'reject'"), list(CLIP))
    moving = clips.join(crops.where("mode = 'motion'").select(*CLIP), list(CLIP), "left_semi")
    states = smooth_track(clip_samples(moving, centroids, videos), videos, keys=CLIP)
    part = F.struct(*CLIP)
    before = F.lag("smoothed_x").over(Window.partitionBy("_part").orderBy("sample_no"))
    shifts = (
        states.withColumn("_part", part)
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .where("smoothed_x <> _before")
        .select(*CLIP, "sample_no", "smoothed_x")
    )
    begin = framed.select(*CLIP, F.lit(None).cast("int").alias("sample_no"), F.when(F.col("mode") == "face", F.col("x_start")).otherwise(0).alias("smoothed_x"))
    sizes = screen_scale(videos).select("video_id", "vertical_w", "width", "scaled_w")
    placed = begin.unionByName(shifts).join(framed, list(CLIP)).join(sizes, "video_id")
    at = F.col("_first") * F.col("_step") - F.col("_begin") + F.col("sample_no") * F.col("_step")
    placed = placed.withColumn("_part", part).withColumn("first_frame", F.coalesce(at, F.lit(0)))
    order = Window.partitionBy("_part").orderBy("first_frame")
    right = F.least(F.col("smoothed_x") + F.col("vertical_w"), F.when(F.col("mode") == "face", F.col("width")).otherwise(F.col("scaled_w")))
    left = F.when(right - F.col("smoothed_x") < F.col("vertical_w"), F.greatest(F.lit(0), right - F.col("vertical_w"))).otherwise(F.col("smoothed_x"))
    return placed.select(
        *CLIP,
        (F.row_number().over(order) - 1).alias("range_no"),
        "mode",
        F.col("first_frame").cast("int").alias("first_frame"),
        (F.lead("first_frame").over(order) - 1).cast("int").alias("_until"),
        (F.col("_n") - 1).cast("int").alias("_end"),
        left.alias("crop_x"),
        right.alias("crop_x2"),
    ).select(*CLIP, "range_no", "mode", "first_frame", F.coalesce("_until", "_end").alias("last_frame"), "crop_x", "crop_x2")
