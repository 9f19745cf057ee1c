"""Fixed-length frames of raw 16-bit mono audio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.operators.ordered import position_chunk, running_sum

BYTES_PER_SAMPLE = 2


PART_CHUNK = 4096


def frame_bytes(sample_rate: int, frame_ms: int) -> int:
    return int(sample_rate * frame_ms / 1000) * BYTES_PER_SAMPLE


def chunk_audio(pcm: DataFrame, sample_rate: int = 16000, frame_ms: int = 30) -> DataFrame:
    """``(video_id, pcm BINARY)`` to ``(video_id, frame_no, frame BINARY)``.

    A trailing partial frame is dropped.  The generator and the slice run in one
    stage, so the whole buffer is not copied per frame.
    """
    n = frame_bytes(sample_rate, frame_ms)
    frames = F.floor(F.octet_length("pcm") / n).cast("int")
    numbered = pcm.where(frames > 0).select(
        "video_id", "pcm", F.explode(F.sequence(F.lit(0), frames - 1)).alias("frame_no")
    )
    return numbered.select(
        "video_id", "frame_no", F.substring("pcm", F.col("frame_no") * n + 1, F.lit(n)).alias("frame")
    )


def chunk_audio_parts(parts: DataFrame, sample_rate: int = 16000, frame_ms: int = 30) -> DataFrame:
    """``chunk_audio`` for sound that comes in parts ``(video_id, part_no, pcm BINARY)``, of any length and order.

    A row holds one part, so sound of any length fits.  Byte offsets are running sums of part lengths,
    taken on lengths alone.  Frames inside a part are cut where it lies; only the ends of parts, less
    than two frames each, are shuffled and joined to the frames that cross a border.  A frame is made of
    at most as many parts as it has bytes.  A trailing partial frame is dropped, as are null and empty parts.
    ``part_no`` is unique in its video; numbers may have gaps.
    """
    n = frame_bytes(sample_rate, frame_ms)
    known = parts.where(F.octet_length("pcm") > 0)
    lengths = known.select("video_id", "part_no", F.octet_length("pcm").alias("_size"))
    offsets = running_sum(
        lengths, ["video_id"], position_chunk("part_no", PART_CHUNK), [F.col("part_no")], F.col("_size"), "_at", inclusive=False
    )
    placed = known.join(offsets.select("video_id", "part_no", "_at", "_size"), ["video_id", "part_no"])
    # Bytes that finish the frame begun before, whole frames after them, and what is left.
    head = F.least(F.pmod(-F.col("_at"), F.lit(n)), F.col("_size"))
    placed = placed.withColumn("_head", head.cast("int")).withColumn("_whole", F.floor((F.col("_size") - F.col("_head")) / n).cast("int"))
    first = F.floor((F.col("_at") + F.col("_head")) / n)
    cut = lambda start, size: F.substring("pcm", start + 1, size)
    inside = placed.where("_whole > 0").select(
        "video_id", "pcm", "_head", first.alias("_first"), F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("_k")
    )
    whole = inside.select(
        "video_id", (F.col("_first") + F.col("_k")).cast("int").alias("frame_no"), cut(F.col("_head") + F.col("_k") * n, F.lit(n)).alias("frame")
    )
    begun = F.col("_head") + F.col("_whole") * n
    ends = F.array(
        F.struct(F.floor(F.col("_at") / n).alias("f"), cut(F.lit(0), F.col("_head")).alias("bytes")),
        F.struct((first + F.col("_whole")).alias("f"), cut(begun, F.col("_size") - begun).alias("bytes")),
    )
    pieces = placed.select("video_id", "part_no", F.inline(F.filter(ends, lambda e: F.octet_length(e["bytes"]) > 0)))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("part_no", "bytes"))), F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["bytes"])
    )
    stitched = (
        pieces.groupBy(F.struct("video_id", "f").alias("_frame"))
        .agg(joined.alias("frame"))
        .where(F.octet_length("frame") == n)
        .select("_frame.video_id", F.col("_frame.f").cast("int").alias("frame_no"), "frame")
    )
    return whole.unionByName(stitched)
