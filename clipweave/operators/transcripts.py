"""Transcript documents, prompt messages and diagnostics from segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import seconds_text
from clipweave.operators.ordered import chunk_key, position_chunk

# Segments per transcript part.  About four hours of speech, so nearly every
# video has one part; only a longer one is cut into several bounded rows.
PART_SEGMENTS = 4096
PREVIEW_CHARS = 200
# The shortest possible line, "0.0 - 0.0: " and a newline, has 12 characters.
SHORTEST_LINE = 12

# The instruction sent with a transcript.
PROMPT_HEAD = """
The input contains a timestamped transcription of a video.
Select a 2-minute segment from the transcription that contains something interesting, useful, surprising, controversial, or thought-provoking.
The selected text should contain only complete sentences.
Do not cut the sentences in the middle.
The selected text should form a complete thought.
Return a JSON object with the following structure:
## Output 
[{
    start: "Start time of the segment in seconds (number)",
    content: "The transcribed text from the selected segment (clean text only, NO timestamps)",
    end: "End time of the segment in seconds (number)"
}]

## Input
"""
PROMPT_TAIL = "\n"
TAIL_PIECE = 2**31 - 1


def transcript_line(sep: str = "\n") -> Column:
    """``{start} - {end}: {text}`` followed by ``sep``."""
    return F.concat(
        seconds_text("start_s"),
        F.lit(" - "),
        seconds_text("end_s"),
        F.lit(": "),
        F.col("text"),
        F.lit(sep),
    )


def build_transcript(
    segments: DataFrame, sep: str = "\n", part_segments: int = PART_SEGMENTS
) -> DataFrame:
    """``(video_id, part_no, transcript)``: segment lines joined in order.

    The whole transcript of a video is its parts joined in ``part_no`` order.  A
    part holds at most ``part_segments`` segments, so no group is unbounded.
    """
    lines = segments.select(
        chunk_key(["video_id"], position_chunk("seg_idx", part_segments).cast("int")).alias("_part"),
        F.struct("seg_idx", transcript_line(sep).alias("line")).alias("_entry"),
    )
    ordered = F.transform(F.array_sort(F.collect_list("_entry")), lambda e: e["line"])
    parts = lines.groupBy("_part").agg(F.array_join(ordered, "").alias("transcript"))
    return parts.select("_part.video_id", F.col("_part.chunk").alias("part_no"), "transcript")


def render_prompt(transcripts: DataFrame) -> DataFrame:
    """``(video_id, role, piece_no, content)``: the two messages asked per video.

    The system message is the instruction with the transcript put in literally;
    the user message is the transcript again.  A message is its pieces joined in
    ``piece_no`` order, so a long transcript never has to fit one row and no
    shuffle is needed.
    """
    text, part = F.col("transcript"), F.col("part_no")

    def piece(role: str, number: Column, content: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"), number.alias("piece_no"), content.alias("content")
        )

    system = piece("system", part, F.when(part == 0, F.concat(F.lit(PROMPT_HEAD), text)).otherwise(text))
    user = piece("user", part, text)
    tail = piece("system", F.lit(TAIL_PIECE), F.lit(PROMPT_TAIL))
    pieces = F.when(part == 0, F.array(system, user, tail)).otherwise(F.array(system, user))
    return transcripts.select("video_id", F.inline(pieces))


def transcript_stats(segments: DataFrame, preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Segment count, transcript length and its first characters, per video.

    The transcript is never built: lengths are summed before the shuffle, and only
    the leading segments that can reach the preview are collected.
    """
    leading = preview_chars // SHORTEST_LINE + 1
    line = transcript_line()
    kept = F.when(F.col("seg_idx") < leading, F.struct("seg_idx", line.alias("line")))
    ordered = F.transform(F.array_sort(F.collect_list(kept)), lambda e: e["line"])
    return segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.length(line)).alias("n_chars"),
        F.substring(F.array_join(ordered, ""), 1, preview_chars).alias("preview"),
    )
