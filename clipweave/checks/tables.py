"""Input tables of the operators, derived from the given parquet tables.

Each function is lazy and reads only the columns it needs.  ``checks/sql.py``
states the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipweave.functions import compute_once, trunc_int
from clipweave.operators.ordered import dense_index, position_chunk
from clipweave.operators.vision import screen_scale

SENTENCE_MARK = "\u001e"
OUTRO_S = 60.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _marked(text: Column) -> Column:
    """Text with a mark in place of the white space behind each sentence."""
    return F.regexp_replace(text, r"([.!?])\s+", "$1" + SENTENCE_MARK)


def _word_counts(marked: Column) -> Column:
    """Words per sentence, one at least: each word becomes one letter, and letters are counted."""
    letters = F.translate(F.regexp_replace(marked, rf"[^\s{SENTENCE_MARK}]+", "w"), " \t\n\x0b\f\r", "")
    return F.transform(F.split(letters, SENTENCE_MARK), lambda s: F.greatest(F.lit(1), F.length(s)))


def _timed_sentences(documents: DataFrame) -> DataFrame:
    """Documents with ``_s``: their sentences as timed segments.

    Four tenths per word.  All per document row, so no shuffle.
    """

    def later(acc: Column, n: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + n * 4)

    staged = compute_once(documents.select("doc_id", "text"), "_m", _marked(F.col("text")))
    staged = staged.select("doc_id", "_m", F.split("_m", SENTENCE_MARK).alias("sentence"))
    staged = compute_once(staged, "n", _word_counts(F.col("_m")))
    staged = compute_once(staged, "_at", F.aggregate("n", F.array(F.lit(0)), later))
    staged = staged.withColumn("at", F.slice("_at", F.lit(1), F.size("n")))
    return compute_once(staged, "_s", F.transform(F.arrays_zip("sentence", "n", "at"), _segment)).select(
        "doc_id", "_s"
    )


def _segment(entry: Column, idx: Column) -> Column:
    end = entry["at"] + entry["n"] * 4 - F.pmod(idx, F.lit(3))
    return F.struct(
        F.concat(F.lit(" "), entry["sentence"]).alias("text"),
        (entry["at"] / F.lit(10.0)).alias("start_s"),
        (end / F.lit(10.0)).alias("end_s"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt by id before they are split: a file of one row group would be split by one task."""
    return load(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


def nested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(video_id, segments ARRAY<STRUCT<text, start_s, end_s>>)``."""
    timed = _timed_sentences(_documents(spark, sf_dir))
    return timed.select(F.col("doc_id").alias("video_id"), F.col("_s").alias("segments"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_segments(spark, sf_dir)
    return nested.select("video_id", F.posexplode("segments").alias("seg_idx", "_s")).select(
        "video_id", "seg_idx", "_s.text", "_s.start_s", "_s.end_s"
    )


def _sizes() -> list[Column]:
    kind = F.pmod(F.col("doc_id"), F.lit(5))

    def by_kind(*values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (kind + 1).cast("int"))

    return [
        F.col("doc_id").alias("video_id"),
        F.col("text").alias("title"),
        F.concat(F.lit("https://example.org/watch/"), F.col("doc_id").cast("string")).alias("source"),
        by_kind(1920, 1280, 640, 3840, 400).alias("width"),
        by_kind(1080, 720, 480, 2160, 854).alias("height"),
        by_kind(30.0, 25.0, 24.0, 60.0, 30.0).alias("fps"),
    ]


def _duration() -> Column:
    """A minute without speech follows the last segment.

    Each sentence lasts longer than its end is moved, so the last one ends last: no segment is made for it.
    """
    start = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("idx"))

    def count(acc: Column, n: Column) -> Column:
        return F.struct((acc["words"] + n).alias("words"), (acc["idx"] + 1).alias("idx"))

    def end(acc: Column) -> Column:
        return (acc["words"] * 4 - F.pmod(acc["idx"], F.lit(3))) / F.lit(10.0) + OUTRO_S

    return F.aggregate(_word_counts(_marked(F.col("text"))), start, count, end)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video per document: title, frame size and rate."""
    return load(spark, sf_dir, "documents").select(*_sizes())


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each video."""
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("video_id"), _duration().alias("duration_s"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and lengths from one pass; whoever asks for no length counts no words."""
    sized = _documents(spark, sf_dir).where(F.col("doc_id").isNotNull()).select(*_sizes(), _duration().alias("duration_s"))
    return sized.withColumn("n_frames", F.floor(F.col("duration_s") * F.col("fps")).cast("long"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies of every kind a parser must tell apart, by document id."""
    d = F.col("doc_id")
    case = F.pmod(d, F.lit(8))
    at = F.pmod(d * 7, F.lit(40))

    def reply(start: Column | str, end: Column | str) -> Column:
        return F.concat(
            F.lit('{"start": '), _text(start), F.lit(', "content": "clip", "end": '), _text(end), F.lit("}")
        )

    valid = reply(F.concat((at + 1).cast("string"), F.lit(".5")), F.concat((at + 120).cast("string"), F.lit(".7")))
    text = (
        F.when(case == 0, valid)
        .when(F.pmod(d, F.lit(16)) == 9, F.concat(F.lit("\n["), valid, F.lit("]\t")))
        .when(case == 1, F.concat(F.lit("["), valid, F.lit("]")))
        .when(F.pmod(d, F.lit(32)) == 18, "\n")
        .when(F.pmod(d, F.lit(32)) == 14, reply("100000", "100060"))
        .when(F.pmod(d, F.lit(16)) == 2, "")
        .when(case == 2, '{"topic": "none"}')
        .when(case == 3, reply("-5", "60"))
        .when(case == 4, reply("90", "30.5"))
        .when(case == 5, reply('"abc"', "30"))
        .when(case == 6, reply("0", "45.2"))
        .otherwise(reply("5.2", "5.9"))
    )
    return load(spark, sf_dir, "documents").select(d.alias("video_id"), text.alias("response"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three replies per video: its own, then those of the documents before it."""
    own = responses(spark, sf_dir)
    numbers = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt")
    return own.select("video_id", "response", numbers).select(
        (F.col("video_id") + F.col("attempt")).alias("video_id"), "attempt", "response"
    )


def attempt_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was decided on each attempt, by video and attempt number."""
    numbered = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt")
    )
    kind = F.pmod(F.floor(F.col("video_id") / F.lit(8)) + F.col("attempt"), F.lit(5))
    decision = F.when(kind < 2, "regenerate").when(kind == 2, "cancel").otherwise("approve")
    return numbered.select("video_id", "attempt", decision.alias("decision"))


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work list with every document; the URL holds its id."""
    url = F.concat(F.lit("https://example.org/watch/"), F.col("doc_id").cast("string"))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), url.alias("item"))


def batch_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that could be fetched: the documents of a language other than Spanish; French ones are silent."""
    url = F.concat(F.lit("https://example.org/watch/"), F.col("doc_id").cast("string"))
    fetched = load(spark, sf_dir, "documents").where(F.col("lang") != "es").select(
        F.col("doc_id").alias("video_id"), url.alias("item"), (F.col("lang") != "fr").alias("has_audio")
    )
    frame = sizes(spark, sf_dir).select("video_id", "width", "height")
    return fetched.join(durations(spark, sf_dir), "video_id").join(frame, "video_id")


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work list: page URLs with padded copies, blank lines and comments between."""
    kind = F.pmod(F.col("page_id"), F.lit(10))
    extra = (
        F.when(kind == 1, F.concat(F.lit("  "), F.col("url"), F.lit("\t")))
        .when(kind == 2, F.lit("   "))
        .when(kind == 3, F.concat(F.lit("# "), F.col("url")))
    )
    both = load(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.filter(F.array("url", extra), lambda x: x.isNotNull())).alias("_k", "line")
    )
    return both.select((F.col("page_id") * 2 + F.col("_k")).alias("line_no"), "line")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return load(spark, sf_dir, "pages").select("page_id", title.alias("title"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/videos/"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), path.alias("item"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/videos/"), F.col("l_orderkey").cast("string"), F.lit(".mp4"))
    return load(spark, sf_dir, "lineitem").select(path.alias("path"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    labels = F.array(*[F.lit(f"{n}p") for n in (2160, 1440, 1080, 720, 480, 360, 144)])
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        idx.alias("stream_idx"),
        F.when(F.col("l_linestatus") == "O", "video").otherwise("audio").alias("type"),
        F.element_at(labels, F.col("l_linenumber")).alias("resolution"),
        F.round(F.col("l_extendedprice") * 1000).cast("long").alias("filesize"),
        (F.col("l_returnflag") == "R").alias("is_progressive"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed answer per video: ranks, padded ranks, noise, far too large, none."""
    kinds = F.array(*[F.lit(a) for a in ("0", "1", " 2 ", "3", "7", "x", "", "12345678901234567890", None)])
    pick = F.element_at(kinds, (F.pmod(F.col("o_orderkey"), F.lit(9)) + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), pick.alias("answer"))


def _boxes(spark: SparkSession, sf_dir: str, n_frames: int) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    x = F.pmod(F.col("l_partkey"), F.lit(1500)).cast("int")
    y = (F.col("l_quantity") * 10).cast("int")
    return line.select(
        F.col("l_suppkey").alias("video_id"),
        F.pmod(F.col("l_orderkey"), F.lit(n_frames)).cast("int").alias("frame_no"),
        (F.round(F.col("l_discount") * 100) / F.lit(10.0)).alias("confidence"),
        x.alias("x"),
        y.alias("y"),
        (x + 20 + F.col("l_linenumber") * 15).alias("x1"),
        (y + 20 + F.col("l_linenumber") * 10 + F.pmod(F.col("l_partkey"), F.lit(40))).cast("int").alias("y1"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("_sort"),
    )


def detections(spark: SparkSession, sf_dir: str, n_frames: int = 600) -> DataFrame:
    """Face boxes; 600 frames leave gaps, 60 frames give about ten boxes each."""
    idx = F.row_number().over(Window.partitionBy("video_id", "frame_no").orderBy("_sort")) - 1
    return _boxes(spark, sf_dir, n_frames).withColumn("det_idx", idx).drop("_sort")


def video_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face boxes dealt over all frames that each video has."""
    lengths = videos(spark, sf_dir).select("video_id", "n_frames")
    boxes = _boxes(spark, sf_dir, 1).join(lengths, "video_id")
    dealt = boxes.withColumn("frame_no", F.pmod(F.col("_sort.l_orderkey") * 7, F.col("n_frames")).cast("int"))
    idx = F.row_number().over(Window.partitionBy("video_id", "frame_no").orderBy("_sort")) - 1
    return dealt.withColumn("det_idx", idx).drop("_sort", "n_frames")


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detections(spark, sf_dir, 60)
    rel = [(F.col(c) / F.lit(s)).alias("r" + c) for c, s in (("x", 1920.0), ("y", 1080.0), ("x1", 1920.0), ("y1", 1080.0))]
    return boxes.select("video_id", "frame_no", "det_idx", "confidence", *rel)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of every video that has sound or faces: up to its last event or detection."""
    heard = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))
    seen = _boxes(spark, sf_dir, 600).groupBy("video_id").agg((F.max("frame_no") + 1).alias("n"))
    ends = heard.union(seen).groupBy("video_id").agg((F.max("n") - 1).cast("int").alias("end"))
    return ends.select("video_id", F.explode(F.sequence(F.lit(0), "end")).alias("frame_no"))


def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        "ts",
        "event_id",
        F.col("event_type").isin("click", "purchase").alias("is_speech"),
    )
    day = F.datediff(F.col("ts"), F.lit("2000-01-01").cast("date"))
    numbered = dense_index(heard, ["video_id"], day, [F.col("ts"), F.col("event_id")], "frame_no")
    return numbered.select("video_id", F.col("frame_no").cast("int").alias("frame_no"), "is_speech")


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.encode("text", "UTF-8").alias("pcm")
    )


def pcm_parts(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """The sound of ``pcm`` in parts of 1,000 bytes, some of them in two."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("pcm") - 1, F.lit(0)), F.lit(size))
    cut = pcm(spark, sf_dir).select("video_id", "pcm", F.posexplode(starts).alias("_k", "_at"))
    short = F.pmod(F.col("_k"), F.lit(7)) == 3
    sizes = F.when(short, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    parts = cut.select("video_id", "pcm", "_k", "_at", short.alias("_short"), F.posexplode(sizes).alias("_j", "_from"))
    length = F.when(F.col("_short") & (F.col("_j") == 0), 3).otherwise(size - F.col("_from"))
    return parts.select(
        "video_id", (F.col("_k") * 2 + F.col("_j")).alias("part_no"), F.substring("pcm", F.col("_at") + F.col("_from") + 1, length).alias("pcm")
    )


def motion(spark: SparkSession, sf_dir: str, spread: int = 1) -> DataFrame:
    """Motion vectors in scaled pixels, 32 columns per sample; label k is video k * ``spread``."""
    labelled = load(spark, sf_dir, "embeddings").select(
        (F.col("label").cast("long") * spread).alias("video_id"), "vec_id", "embedding"
    )
    vectors = dense_index(
        labelled, ["video_id"], position_chunk("vec_id", 4096), [F.col("vec_id")], "sample_no"
    ).withColumn("sample_no", F.col("sample_no").cast("int"))
    pairs = vectors.select(
        "video_id", "sample_no", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_p")
    )
    value = lambda k: F.get("embedding", F.col("_p") * 2 + k).cast("double") * 10
    scaled = screen_scale(sizes(spark, sf_dir)).select("video_id", "scaled_w")
    return pairs.join(scaled, "video_id").select(
        "video_id",
        "sample_no",
        F.floor(F.col("_p") * F.col("scaled_w") / F.lit(32.0)).cast("int").alias("x"),
        F.lit(0).alias("y"),
        value(0).alias("fx"),
        value(1).alias("fy"),
    )


def clip_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion samples again, for videos whose reply gives a clip."""
    return motion(spark, sf_dir, 8)


def motion_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames the motion samples cover."""
    last = load(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("video_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sized = last.join(sizes(spark, sf_dir).select("video_id", "fps"), "video_id")
    end = (F.col("_n") * trunc_int(F.col("fps")) - 1).cast("int")
    return sized.select("video_id", F.explode(F.sequence(F.lit(0), end)).alias("frame_no"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        F.col("event_id").alias("prompt_id"), "user_id", F.col("ts").cast("timestamp").alias("ts")
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", "y").when(kind == "purchase", " R ").when(kind == "error", "n").otherwise("")
    )
    return load(spark, sf_dir, "events").where(kind != "view").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), answer.alias("answer")
    )


def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finished runs: F failed, O succeeded, P still open."""
    kind = F.col("o_orderstatus")
    status = F.when(kind == "F", "failed").when(kind == "O", "success").otherwise("pending")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), status.alias("status"))


def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel listing in which every page shows up under two tabs."""
    tabs = F.array(*[F.lit(t) for t in ("videos", "streams", "shorts", "playlists")])
    pages = load(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.length("html").cast("double").alias("duration_s"),
        F.explode(F.array(F.lit(0), F.lit(2))).alias("_k"),
    )
    return pages.select(
        "url",
        F.element_at(tabs, (F.pmod(F.col("page_id") + F.col("_k"), F.lit(4)) + 1).cast("int")).alias("tab"),
        "duration_s",
        F.pmod(F.col("page_id") * 37, F.lit(1000)).alias("view_count"),
        F.pmod(F.col("page_id") * 11, F.lit(365)).alias("upload_date"),
    )
