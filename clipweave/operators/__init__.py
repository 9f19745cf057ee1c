from clipweave.operators.captions import (
    caption_counts,
    caption_layout,
    clip_captions,
    default_style,
    merge_style,
    overlay_plan,
    overlay_style,
)
from clipweave.operators.decisions import approve, first_answer, settle_attempts
from clipweave.operators.highlights import clamp_clip, gate_highlights, parse_highlight
from clipweave.operators.items import (
    discover,
    item_outcomes,
    outcome_funnel,
    pending_items,
    pending_transcription,
    route_inputs,
    take_until,
)
from clipweave.operators.motion import (
    clip_samples,
    crop_per_frame,
    crop_ranges,
    crop_window,
    motion_centroid,
    smooth_track,
)
from clipweave.operators.ordered import dense_index, fill_forward, position_chunk, running_sum
from clipweave.operators.spans import all_spans, best_span, candidate_spans, sentence_edges, span_text
from clipweave.operators.speaker import active_speaker, fill_track, lip_distance, zip_audio
from clipweave.operators.streams import attach_audio, choose_stream, rank_streams
from clipweave.operators.transcripts import build_transcript, render_prompt, transcript_stats
from clipweave.operators.vision import (
    clip_detections,
    face_crop_ranges,
    face_crop_windows,
    face_windows,
    largest_face,
    nms,
    sample_frames,
    scale_boxes,
    screen_scale,
    static_crop,
    unique_faces,
    vertical_dims,
)

__all__ = [name for name in dir() if not name.startswith("_")]
