"""Candidate highlight spans made of whole sentences, and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions import strip
from clipweave.operators.ordered import chunk_key, position_chunk
from clipweave.session import ensure_checkpoint_dir

TARGET_S = 120.0
TOLERANCE_S = 10.0
SENTENCE_END = r"[.!?]\s*$"
SEG_CHUNK = 4096
TEXT_CHUNK = 64
GREEDY_CHUNK_S = 1800.0
# Multipliers that scatter segment numbers over 32 bits.
SCATTER_FIRST = 2654435761
SCATTER_LAST = 40503
SCATTER_RANGE = 1 << 32
_ROUNDING = 1e-6

SPAN_KEY = ["video_id", "first_idx", "last_idx"]


def sentence_edges(segments: DataFrame) -> DataFrame:
    """Add ``opens`` and ``closes``: may a span start or end with this segment?

    A segment closes if its text ends a sentence; it opens if it is the first of
    its video or the one before it closes.  The last segment of each chunk is also
    put into the next chunk, so looking one row back never needs the whole video.
    """
    chunk = position_chunk("seg_idx", SEG_CHUNK)
    is_last = F.pmod(F.col("seg_idx"), F.lit(SEG_CHUNK)) == SEG_CHUNK - 1
    spread = segments.select(
        "video_id",
        "seg_idx",
        "start_s",
        "end_s",
        F.col("text").rlike(SENTENCE_END).alias("closes"),
        F.explode(F.when(is_last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("_chunk"),
    ).withColumn("_part", chunk_key(["video_id"], F.col("_chunk")))
    previous = F.lag("closes").over(Window.partitionBy("_part").orderBy("seg_idx"))
    return (
        spread.withColumn("opens", F.coalesce(previous, F.lit(True)))
        .where(F.col("_chunk") == chunk)
        .drop("_chunk", "_part")
    )


def candidate_spans(
    segments: DataFrame, target_s: float = TARGET_S, tol_s: float = TOLERANCE_S
) -> DataFrame:
    """``(video_id, first_idx, last_idx, start_s, end_s, span_s)`` near the wanted length.

    Openers meet closers on video and time bucket, where each opener looks into
    the two or three buckets its end may fall in: the rows that meet are about the
    rows returned, and a long video is spread over its buckets.  Both come from one
    pass over the text, and one shuffle brings them together.
    """
    width = max(2 * tol_s, 1.0)
    low = F.floor((F.col("start_s") + target_s - tol_s - _ROUNDING) / width)
    high = F.floor((F.col("start_s") + target_s + tol_s + _ROUNDING) / width)
    none = F.array().cast("array<bigint>")
    buckets = F.concat(
        F.when(F.col("closes"), F.array(F.floor(F.col("end_s") / width))).otherwise(none),
        F.when(F.col("opens"), F.sequence(low, high)).otherwise(none),
    )
    placed = sentence_edges(segments).where("opens or closes").select(
        "video_id", "seg_idx", "start_s", "end_s", "closes", F.posexplode(buckets).alias("_k", "_b")
    )
    is_closer = F.col("closes") & (F.col("_k") == 0)
    met = placed.groupBy(F.struct("video_id", "_b").alias("_part")).agg(
        F.collect_list(F.when(~is_closer, F.struct(F.col("seg_idx").alias("first_idx"), "start_s"))).alias("_openers"),
        F.collect_list(F.when(is_closer, F.struct(F.col("seg_idx").alias("last_idx"), "end_s"))).alias("_closers"),
    )
    length = F.col("end_s") - F.col("start_s")
    return (
        met.select("_part.video_id", F.explode("_openers").alias("_o"), "_closers")
        .select("video_id", "_o.first_idx", "_o.start_s", F.inline("_closers"))
        .where(
            (F.col("last_idx") >= F.col("first_idx"))
            & length.between(F.lit(target_s - tol_s), F.lit(target_s + tol_s))
        )
        .select(*SPAN_KEY, "start_s", "end_s", length.alias("span_s"))
    )


def span_text(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``content``: the stripped text of the span's segments, joined by spaces.

    Meant for chosen spans, not for all candidates.  Spans and segments meet on
    video and a small run of segment numbers.
    """
    runs = F.sequence(position_chunk("first_idx", TEXT_CHUNK), position_chunk("last_idx", TEXT_CHUNK))
    wanted = spans.select(*SPAN_KEY, F.explode(runs).alias("_r"))
    words = segments.select(
        "video_id", "seg_idx", strip("text").alias("_text"), position_chunk("seg_idx", TEXT_CHUNK).alias("_r")
    )
    parts = (
        wanted.join(words, ["video_id", "_r"])
        .where(F.col("seg_idx").between(F.col("first_idx"), F.col("last_idx")))
        .groupBy(F.struct(*SPAN_KEY).alias("_span"))
        .agg(F.array_sort(F.collect_list(F.struct("seg_idx", "_text"))).alias("_parts"))
        .select("_span.*", F.array_join(F.transform("_parts", lambda p: p["_text"]), " ").alias("content"))
    )
    return spans.join(parts, SPAN_KEY)


def _ranking(score: Column) -> list[Column]:
    """Highest score first; ties go to the smaller scattered number, see ``all_spans``."""
    return [score.desc(), _scattered(), F.col("first_idx"), F.col("last_idx")]


def _scattered() -> Column:
    first, last = F.col("first_idx").cast("long"), F.col("last_idx").cast("long")
    return F.pmod(first * SCATTER_FIRST + last * SCATTER_LAST, F.lit(SCATTER_RANGE))


def best_span(spans: DataFrame, score: Column) -> DataFrame:
    """The best span of each video, with its ``score``.

    The score is the caller's; only the shape of the result is promised.  The
    limit to one row is applied before the shuffle too.
    """
    scored = spans.withColumn("score", score)
    first = F.row_number().over(Window.partitionBy("video_id").orderBy(*_ranking(F.col("score"))))
    return scored.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def all_spans(
    spans: DataFrame, score: Column, single: bool = False, chunk_s: float = GREEDY_CHUNK_S
) -> DataFrame:
    """Every good span: the best first, then the best that overlaps none taken yet.

    ``single`` returns only the best one, which is also the first of all.  Exact and parallel within a
    video: time is cut into chunks of ``chunk_s``, a fixed width, and each chunk is settled on its own
    by one fold over its spans, best first.  A span that reaches into another chunk, and what
    overlaps it and ranks lower, stays open for a further round, with the cuts moved by half a chunk.

    Rounds: a span that waits for none is settled as soon as it lies inside one chunk, which is so in one
    of two rounds (the width is at least twice the longest span, else it is raised to that once).  Waiting
    spans overlap one by one, so a chain of them that spans k half chunks takes at most about 2 k + 2
    rounds, however it is ordered: a chunk settles all of a chain that lies in it at once.  So rounds are
    bounded by the length of the longest video over the width; a video shorter than a chunk takes one or two.

    Equal scores are ranked by a scattering of the segment numbers: ranked by time,
    each span would wait for the one before it, and chains would be as long as the video.
    """
    if single:
        return best_span(spans, score)
    spark = spans.sparkSession
    ensure_checkpoint_dir(spark)
    open_spans = spans.withColumn("score", score).withColumn("_tie", _scattered())
    names = open_spans.columns
    chosen = None
    shift = 0.0
    while True:
        low = F.floor((F.col("start_s") + shift) / chunk_s)
        high = F.floor((F.col("end_s") + shift) / chunk_s)
        placed = open_spans.withColumn("_alone", low == high).withColumn("_chunk", F.explode(F.sequence(low, high)))
        fates = _settled(placed, names).checkpoint()
        picked = fates.where(F.col("_fate") == _CHOSEN).select(*names)
        chosen = picked if chosen is None else chosen.unionByName(picked)
        # A span in several chunks comes back from each; it stays open if all of them leave it open.
        inside = fates.where(F.col("_alone") & (F.col("_fate") == _OPEN)).select(*names)
        across = (
            fates.where(~F.col("_alone"))
            .groupBy(F.struct(*names).alias("_span"))
            .agg(F.max("_fate").alias("_fate"))
            .where(F.col("_fate") == _OPEN)
            .select("_span.*")
        )
        open_spans = inside.unionByName(across)
        longest = open_spans.agg(F.max(F.col("end_s") - F.col("start_s"))).first()[0]
        if longest is None:
            return chosen.drop("_tie")
        chunk_s = max(chunk_s, 2.0 * longest)
        shift = chunk_s / 2 if shift == 0.0 else 0.0


_OPEN, _CHOSEN, _REJECTED = 0, 1, 2


def _settled(placed: DataFrame, names: list[str]) -> DataFrame:
    """The fate of each span of each (video, chunk) as far as the chunk alone can tell.

    Best first: a span that overlaps a chosen one is rejected; one that reaches into another chunk,
    or overlaps a better one still open, stays open; any other is chosen.  Rejected spans that lie in one
    chunk are not returned.  What is held while folding are the chosen and open spans of one chunk.
    """
    key = ["video_id"]
    rest = [c for c in names if c not in (*key, "score", "_tie", "first_idx", "last_idx")]
    # Fields in ranking order, so that sorting the structs ranks the spans.
    span = F.struct(F.col("score").isNull().alias("_none"), (-F.col("score")).alias("_rank"), "_tie", "first_idx", "last_idx", *rest, "score", "_alone")
    groups = placed.groupBy(chunk_key(key, F.col("_chunk")).alias("_part")).agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    overlaps = lambda kept, x: F.exists(kept, lambda k: (k["start_s"] < x["end_s"]) & (x["start_s"] < k["end_s"]))

    def told(x: Column, fate: int) -> Column:
        return F.array(F.struct(x.alias("span"), F.lit(fate).alias("fate")))

    def step(acc: Column, x: Column) -> Column:
        rejected = overlaps(acc["chosen"], x)
        waits = ~x["_alone"] | overlaps(acc["open"], x)
        return F.when(
            rejected,
            F.when(x["_alone"], acc).otherwise(acc.withField("told", F.concat(acc["told"], told(x, _REJECTED)))),
        ).when(waits, acc.withField("open", F.array_append(acc["open"], x))).otherwise(
            acc.withField("chosen", F.array_append(acc["chosen"], x))
        )

    none = F.slice("_spans", 1, 0)
    nothing = F.slice(F.transform("_spans", lambda x: F.struct(x.alias("span"), F.lit(_OPEN).alias("fate"))), 1, 0)
    start = F.struct(none.alias("chosen"), none.alias("open"), nothing.alias("told"))
    mark = lambda kept, fate: F.transform(kept, lambda x: F.struct(x.alias("span"), F.lit(fate).alias("fate")))
    close = lambda acc: F.concat(mark(acc["chosen"], _CHOSEN), mark(acc["open"], _OPEN), acc["told"])
    settled = groups.select(F.col("_part.video_id").alias("video_id"), F.explode(F.aggregate("_spans", start, step, close)).alias("_x"))
    fields = [c for c in names if c not in key]
    return settled.select("video_id", *[F.col("_x.span")[c].alias(c) for c in fields], F.col("_x.span._alone").alias("_alone"), F.col("_x.fate").alias("_fate")).select(
        *names, "_alone", "_fate"
    )
