"""One query per operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import functions as fn
from clipweave import operators as op
from clipweave import sources as src
from clipweave.checks import streams
from clipweave.checks import tables as t
from clipweave.plans import batch_outcomes as plan_batch
from clipweave.plans import run_until
from clipweave.plans import clips as plan
from clipweave.session import ensure_checkpoint_dir
from clipweave.sources.manifest import temp_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The stop count used as an example for long unattended runs.
TARGET_COUNT = 200


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Sources and sinks ---------------------------------------------------------


@query
def read_items(spark, d):
    return src.items_from_lines(t.lines(spark, d))


@query
def preview_items(spark, d):
    return src.preview_items(src.items_from_lines(t.lines(spark, d)))


@query
def route_inputs(spark, d):
    return op.route_inputs(t.order_items(spark, d), t.files(spark, d))


@query
def route_inputs_from_storage(spark, d):
    """Suppliers' videos looked up in a folder tree that holds those of some nations."""
    folder = f"{streams.stage_dir(spark)}/videos"
    nations = t.load(spark, d, "nation").where(F.col("n_regionkey") < 3)
    nations.select(F.col("n_nationkey").alias("nation"), "n_name").write.partitionBy("nation").text(folder)
    listed = src.list_files(spark, folder, "*.txt").select(F.regexp_extract("path", "(/videos/nation=[0-9]+)/", 1).alias("path"))
    name = F.concat(F.lit("/videos/nation="), F.col("s_nationkey").cast("string"))
    items = t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("line_no"), name.alias("item"))
    return op.route_inputs(items, listed)


@query
def read_work_list(spark, d):
    """Page URLs written as a text list and read back."""
    path = f"{streams.stage_dir(spark)}/list"
    src.write_channel(t.load(spark, d, "pages").select("url"), path)
    return src.read_items(spark, path).select("item")


@query
def read_segment_files(spark, d):
    """Transcripts written as JSON documents, one per video, and read back."""
    path = f"{streams.stage_dir(spark)}/segments"
    t.nested_segments(spark, d).write.json(path)
    return src.read_segments(spark, path)


@query
def plan_sink(spark, d):
    """A plan is stored; a second run replaces the rows of one status only."""
    path = f"{streams.stage_dir(spark)}/plan"
    rows = op.item_outcomes(_stages(spark, d)).select("video_id", "status", "exit_code")
    src.update_plan(rows, path, "run-1")
    src.update_plan(rows.where("status = 'success'"), path, "run-2")
    return src.read_plan(spark, path).select("video_id", "status", "exit_code", "run_id")


@query
def title_from_path(spark, d):
    """Page URLs with an extension, local and downloaded."""
    path = F.concat(F.col("url"), F.lit(".webm"))
    local, fetched = fn.title_from_path(path), fn.title_from_path(path, downloaded=True)
    return t.load(spark, d, "pages").select("page_id", local.alias("local"), fetched.alias("fetched"))


@query
def rank_streams(spark, d):
    return op.rank_streams(t.streams(spark, d))


@query
def choose_stream(spark, d):
    return op.choose_stream(t.streams(spark, d), t.answers(spark, d))


@query
def attach_audio(spark, d):
    streams = t.streams(spark, d)
    chosen = op.choose_stream(streams, t.answers(spark, d))
    return op.attach_audio(chosen, streams).select("video_id", "stream_idx", "is_progressive", "audio_idx")


@query
def read_segments(spark, d):
    return src.explode_segments(t.nested_segments(spark, d))


@query
def pending_transcription(spark, d):
    """Videos whose document is not in the label table yet."""
    done = t.load(spark, d, "labels").select(F.col("doc_id").alias("video_id"))
    return op.pending_transcription(t.durations(spark, d), done).select("video_id", "duration_s")


@query
def clip_manifest(spark, d):
    return plan.clip_manifest(
        t.videos(spark, d), t.segments(spark, d), t.responses(spark, d), t.video_detections(spark, d), t.clip_motion(spark, d)
    )


@query
def many_clip_manifest(spark, d):
    """Several clips per video, each with its own names and crop plan."""
    return plan.many_clip_manifest(
        t.videos(spark, d), t.segments(spark, d), _score(), t.video_detections(spark, d), t.clip_motion(spark, d)
    )


@query
def clip_crop_ranges(spark, d):
    return plan.clip_crop_ranges(
        _clips(spark, d), t.video_detections(spark, d), t.clip_motion(spark, d), t.sizes(spark, d)
    )


@query
def clip_crops(spark, d):
    return plan.clip_crops(_clips(spark, d), t.video_detections(spark, d), t.sizes(spark, d))


@query
def temp_file_names(spark, d):
    keyed = t.titles(spark, d).select("page_id", fn.session_key("page_id", "title").alias("session"))
    return keyed.select("page_id", *[c.alias(n) for n, c in temp_names().items()])


@query
def chunk_audio(spark, d):
    frames = src.chunk_audio(t.pcm(spark, d))
    return frames.select("video_id", "frame_no", F.md5("frame").alias("digest"))


@query
def chunk_audio_parts(spark, d):
    frames = src.chunk_audio_parts(t.pcm_parts(spark, d))
    return frames.select("video_id", "frame_no", F.md5("frame").alias("digest"))


@query
def export_channel(spark, d):
    return src.export_channel(t.channel(spark, d), ["videos", "streams"])


# Projections, filters, scalar expressions ----------------------------------


@query
def slug(spark, d):
    return t.titles(spark, d).select("page_id", fn.slug("title").alias("slug"))


@query
def safe_title(spark, d):
    return t.titles(spark, d).select("page_id", fn.safe_title(F.concat("title", F.lit(' a|b:c?*<d>"/\\'))).alias("safe"))


@query
def session_key(spark, d):
    return t.sizes(spark, d).select("video_id", fn.session_key("video_id", "title").alias("session"))


@query
def output_name(spark, d):
    name = fn.output_name(fn.strip("title"), fn.session_key("video_id"))
    return t.sizes(spark, d).select("video_id", name.alias("output"))


@query
def vertical_dims(spark, d):
    return op.vertical_dims(t.sizes(spark, d)).select("video_id", "vertical_w", "vertical_h", "dims_status")


@query
def screen_scale(spark, d):
    return op.screen_scale(t.sizes(spark, d)).select(
        "video_id", "scale", "scaled_w", "scaled_h", "offset_y", "max_x"
    )


def _highlights(spark, d):
    return op.gate_highlights(op.parse_highlight(t.responses(spark, d)))


@query
def clamp_clip(spark, d):
    return op.clamp_clip(_highlights(spark, d), t.durations(spark, d))


@query
def gate_highlights(spark, d):
    return _highlights(spark, d).select("video_id", "start_s", "stop_s")


def _clips(spark, d):
    """One small row per clip, used in several branches: computed once."""
    ensure_checkpoint_dir(spark)
    return plan.single_clips(t.responses(spark, d), t.durations(spark, d)).checkpoint()


@query
def caption_layout(spark, d):
    captions = op.clip_captions(_clips(spark, d), t.segments(spark, d))
    dims = op.vertical_dims(t.sizes(spark, d)).select(
        "video_id", F.col("vertical_w").alias("width"), F.col("vertical_h").alias("height")
    )
    # The renderer's text height is stood in for by 40 pixels per started 35 characters.
    lines = F.ceil(F.length("text") / F.lit(35)).cast("int") * 40
    sized = captions.join(dims, "video_id").withColumn("text_h", F.when(F.col("seg_idx") % 2 == 0, lines))
    return op.caption_layout(sized).drop("text", "status", "clip_idx", "width", "height", "text_h")


@query
def wrap_text(spark, d):
    return t.segments(spark, d).select("video_id", "seg_idx", fn.wrap_text("text").alias("lines"))


@query
def overlay_plan(spark, d):
    return op.overlay_plan(t.segments(spark, d)).select("video_id", "seg_idx", "color", "start_s", "end_s")


def _styled(plan_rows):
    """Overlays with the defaults, the demo settings and the colour of each."""
    third = F.pmod(F.col("seg_idx"), F.lit(3)) == 2
    override = F.create_map(
        F.lit("fontsize"), F.lit("15"),
        F.lit("margin_bottom"), F.when(F.pmod(F.col("seg_idx"), F.lit(7)) != 4, "100"),
        F.lit("fade_duration"), F.when(F.pmod(F.col("seg_idx"), F.lit(11)) != 6, "0.1"),
        F.lit("animation_style"), F.when(third, F.lit("none")).otherwise(F.lit("fade")),
        F.lit("position"), F.when(third, F.lit("center,center")).otherwise(F.lit("center,bottom")),
        F.lit("color"), F.col("color"),
    )
    given = F.map_filter(override, lambda _, x: x.isNotNull())
    return plan_rows.withColumn("style", op.merge_style(op.default_style(), given))


@query
def merge_style(spark, d):
    entries = F.array_sort(F.transform(F.map_entries("style"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _styled(op.overlay_plan(t.segments(spark, d))).select("video_id", "seg_idx", F.array_join(entries, ";").alias("style"))


@query
def overlay_style(spark, d):
    """The style is made behind the join: a map per overlay would be sorted with it."""
    dims = t.sizes(spark, d).select("video_id", "width", "height")
    styled = _styled(op.overlay_plan(t.segments(spark, d)).join(dims, "video_id")).withColumn("text_h", F.lit(40))
    return op.overlay_style(styled).select("video_id", "seg_idx", "box_width", "fade_s", "pos_y", "shown_s", "style_status")


@query
def scale_boxes(spark, d):
    return op.scale_boxes(t.raw_detections(spark, d), t.sizes(spark, d))


@query
def lip_distance(spark, d):
    return op.lip_distance(t.detections(spark, d, 60)).select("video_id", "frame_no", "det_idx", "lip")


def _face_windows(spark, d):
    return op.face_windows(op.unique_faces(t.detections(spark, d, 60)), t.sizes(spark, d))


@query
def face_windows(spark, d):
    return _face_windows(spark, d)


@query
def face_crop_windows(spark, d):
    windows = _face_windows(spark, d)
    return op.face_crop_windows(t.frames(spark, d), windows).select(
        "video_id", "frame_no", "face_no", "crop_x", "crop_y", "crop_x2", "crop_y2"
    )


@query
def face_crop_ranges(spark, d):
    return op.face_crop_ranges(t.frames(spark, d), _face_windows(spark, d))


@query
def render_prompt(spark, d):
    return op.render_prompt(op.build_transcript(t.segments(spark, d)))


@query
def parse_highlight(spark, d):
    return op.parse_highlight(t.responses(spark, d))


@query
def transcript_stats(spark, d):
    return op.transcript_stats(t.segments(spark, d))


@query
def discover(spark, d):
    return op.discover(t.channel(spark, d), 900.0, 7200.0).select("url", "tab", "duration_s", "view_count", "upload_date")


# Joins ----------------------------------------------------------------------


@query
def clip_captions(spark, d):
    return op.clip_captions(_clips(spark, d), t.segments(spark, d))


@query
def zip_audio(spark, d):
    return op.zip_audio(t.frames(spark, d), t.audio_frames(spark, d))


def _track(spark, d):
    return op.smooth_track(op.motion_centroid(t.motion(spark, d)), t.sizes(spark, d))


@query
def crop_per_frame(spark, d):
    return op.crop_per_frame(t.motion_frames(spark, d), _track(spark, d), t.sizes(spark, d))


@query
def first_answer(spark, d):
    return op.first_answer(t.prompts(spark, d), t.decisions(spark, d), timeout_s=7200.0)


@query
def approve(spark, d):
    return op.approve(t.prompts(spark, d), t.decisions(spark, d), timeout_s=7200.0)


@query
def pending_items(spark, d):
    items = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_linenumber", "l_partkey")
    return op.pending_items(items, t.run_state(spark, d))


@query
def pending_items_with_retry(spark, d):
    items = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_linenumber", "l_partkey")
    return op.pending_items(items, t.run_state(spark, d), retry_failures=True)


# Aggregations ---------------------------------------------------------------


@query
def build_transcript(spark, d):
    return op.build_transcript(t.segments(spark, d))


@query
def largest_face(spark, d):
    return op.largest_face(t.detections(spark, d, 60))


@query
def static_crop(spark, d):
    return op.static_crop(op.largest_face(t.detections(spark, d, 60)), t.sizes(spark, d))


@query
def motion_centroid(spark, d):
    return op.motion_centroid(t.motion(spark, d))


def _speakers(spark, d):
    boxes = t.detections(spark, d).where(F.col("confidence") > 0.3)
    return op.active_speaker(boxes, op.zip_audio(t.frames(spark, d), t.audio_frames(spark, d)))


@query
def active_speaker(spark, d):
    return _speakers(spark, d).select("video_id", "frame_no", "lip", "box.x", "box.y", "box.x1", "box.y1", "is_active")


@query
def unique_faces(spark, d):
    return op.unique_faces(t.detections(spark, d, 60))


@query
def outcome_funnel(spark, d):
    return op.outcome_funnel(op.item_outcomes(_stages(spark, d)))


@query
def item_outcomes(spark, d):
    return op.item_outcomes(_stages(spark, d)).select("video_id", "status", "exit_code")


def _stages(spark, d):
    counts = t.segments(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"))
    parsed = op.parse_highlight(t.responses(spark, d)).select(
        "video_id", (F.col("status") == "ok").alias("highlight_ok"), "start_s", "stop_s"
    )
    v = F.col("video_id")
    decision = F.when(F.pmod(v, F.lit(11)) == 3, "cancel").when(F.pmod(v, F.lit(11)) == 5, "regenerate_failed")
    return (
        t.durations(spark, d)
        .select("video_id", "duration_s")
        .join(counts, "video_id", "left")
        .join(parsed, "video_id", "left")
        .join(t.sizes(spark, d).select("video_id", "width", "height"), "video_id")
        .withColumn("n_segments", F.when(F.pmod(v, F.lit(50)) == 9, 0).otherwise(F.col("n_segments")))
        .withColumn("has_video", F.pmod(v, F.lit(50)) != 7)
        .withColumn("has_audio", F.pmod(v, F.lit(50)) != 8)
        .withColumn("decision", decision.otherwise("approve"))
    )


@query
def settle_attempts(spark, d):
    parsed = op.parse_highlight(t.attempts(spark, d), keep=["attempt"])
    asked = parsed.join(t.attempt_decisions(spark, d), ["video_id", "attempt"], "left")
    return op.settle_attempts(asked)


@query
def batch_outcomes(spark, d):
    return plan_batch(
        t.batch_items(spark, d),
        t.batch_videos(spark, d),
        t.segments(spark, d),
        t.attempts(spark, d),
        t.attempt_decisions(spark, d),
    )


@query
def take_until(spark, d):
    results = t.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("line_no"), (F.col("o_orderstatus") == "F").alias("success")
    )
    return op.take_until(results, TARGET_COUNT)


@query
def unattended_run(spark, d):
    """Batches against stored state until 20 items have succeeded; stopped after two batches and started again."""
    ensure_checkpoint_dir(spark)
    outcomes = op.item_outcomes(_stages(spark, d)).select(F.col("video_id").cast("string").alias("item_id"), F.col("status").alias("outcome"))
    outcomes = outcomes.checkpoint()
    items = t.load(spark, d, "documents").select(F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("item_id"))
    state = f"{streams.stage_dir(spark)}/runs"
    work = lambda todo: todo.join(outcomes, "item_id").select("item_id", "outcome")
    run_until(items, work, state, 20, 50, max_batches=2)
    return run_until(items, work, state, 20, 50)


# Closeness to the wanted length; the real score comes from a model.
def _score():
    return -F.abs(F.col("span_s") - F.lit(120.0))


@query
def sentence_edges(spark, d):
    return op.sentence_edges(t.segments(spark, d)).select("video_id", "seg_idx", "opens", "closes")


@query
def candidate_spans(spark, d):
    return op.candidate_spans(t.segments(spark, d))


@query
def best_span(spark, d):
    return op.best_span(op.candidate_spans(t.segments(spark, d)), _score())


@query
def span_text(spark, d):
    segments = t.segments(spark, d)
    best = op.best_span(op.candidate_spans(segments), _score())
    return op.span_text(best, segments).select("video_id", "first_idx", "last_idx", "content")


@query
def all_spans(spark, d):
    return op.all_spans(op.candidate_spans(t.segments(spark, d)), _score())


@query
def many_clips(spark, d):
    spans = op.candidate_spans(t.segments(spark, d))
    return plan.many_clips(spans, _score(), t.durations(spark, d))


# Ordered operators ----------------------------------------------------------


@query
def fill_track(spark, d):
    return op.fill_track(_speakers(spark, d)).select("video_id", "frame_no", "box.x", "box.y", "box.x1", "box.y1")


@query
def smooth_track(spark, d):
    return _track(spark, d)


@query
def crop_window(spark, d):
    videos = t.sizes(spark, d)
    return op.crop_window(op.crop_per_frame(t.motion_frames(spark, d), _track(spark, d), videos), videos)


@query
def sample_frames(spark, d):
    return op.sample_frames(t.frames(spark, d), t.sizes(spark, d))


@query
def nms(spark, d):
    return op.nms(t.detections(spark, d, 60))


# Streaming ------------------------------------------------------------------


@query
def approve_stream(spark, d):
    return streams.approvals(spark, d, timeout_s=7200.0)


@query
def smooth_stream(spark, d):
    return streams.smoothing(spark, d)


@query
def smooth_stream_with_losses(spark, d):
    return streams.smoothing_with_losses(spark, d)


@query
def settle_stream(spark, d):
    return streams.attempts(spark, d)


@query
def items_stream_runs(spark, d):
    return streams.runs(spark, d)


@query
def items_stream(spark, d):
    return streams.items(spark, d)
