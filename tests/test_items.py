from pyspark.sql import functions as F

from clipweave import operators as op
from clipweave import sources as src
from tests.conftest import rows


def test_read_items_keeps_order_and_duplicates(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("https://a\r\n\n  # note\n\thttps://b \n#x\nhttps://a\n", encoding="utf-8")
    got = src.read_items(spark, str(path)).orderBy("line_no")
    assert [tuple(r) for r in got.collect()] == [(0, "https://a"), (3, "https://b"), (5, "https://a")]
    preview = src.preview_items(src.read_items(spark, str(path))).orderBy("position")
    assert [r.preview for r in preview.collect()] == ["001. https://a", "002. https://b", "003. https://a"]


def test_read_lines_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    lines = [f"https://example.org/watch/{i}" for i in range(5000)]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = src.read_lines(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        got = {r.line_no: r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == dict(enumerate(lines))


def test_channel_round_trip(spark, tmp_path):
    listing = spark.createDataFrame(
        [("u1", "videos"), ("u1", "shorts"), ("u2", "streams"), ("u3", "playlists")], "url STRING, tab STRING"
    )
    out = str(tmp_path / "urls")
    src.write_channel(src.export_channel(listing), out)
    assert sorted(r.item for r in src.read_items(spark, out).collect()) == ["u1", "u2"]
    assert [r.url for r in src.export_channel(listing, ["videos"]).collect()] == ["u1"]


def test_route_inputs(spark):
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "line_no INT, item STRING")
    files = spark.createDataFrame([("a",), ("a",), ("c",)], "path STRING")
    assert rows(op.route_inputs(items, files)) == [(0, "a", "file"), (1, "b", "url"), (2, "a", "file")]


def test_pending(spark):
    items = spark.createDataFrame([(i,) for i in "abcd"], "item_id STRING")
    state = spark.createDataFrame(
        [("a", "success"), ("b", "failed"), ("c", "pending"), ("a", "failed")], "item_id STRING, status STRING"
    )
    assert rows(op.pending_items(items, state)) == [("c",), ("d",)]
    assert rows(op.pending_items(items, state, retry_failures=True)) == [("b",), ("c",), ("d",)]


def test_take_until_stops_at_the_nth_success(spark):
    data = [(i, i % 3 == 2) for i in range(30)]
    df = spark.createDataFrame(data, "line_no INT, success BOOLEAN")
    assert rows(op.take_until(df, 2)) == [(i, i % 3 == 2) for i in range(6)]
    assert op.take_until(df, 100).count() == 30
    assert op.take_until(df, 0).count() == 0


def test_take_until_over_many_chunks(spark):
    df = spark.range(200_000).select(F.col("id").alias("line_no"), (F.col("id") % 10 == 9).alias("success"))
    got = op.take_until(df, 15_000)
    assert got.count() == 150_000 and got.agg(F.max("line_no")).first()[0] == 149_999


def test_outcomes(spark):
    schema = (
        "item STRING, has_video BOOLEAN, has_audio BOOLEAN, n_segments INT, highlight_ok BOOLEAN,"
        "decision STRING, start_s INT, stop_s INT, duration_s DOUBLE, width INT, height INT"
    )
    data = [
        ("1", False, False, 0, False, None, None, None, None),
        ("2", True, False, 0, False, None, None, None, None),
        ("3", True, True, 0, False, None, None, None, None),
        ("4", True, True, 5, False, None, None, None, 100.0),
        ("5", True, True, 5, True, "cancel", 3, 50, 100.0),
        ("6", True, True, 5, True, "regenerate_failed", 3, 50, 100.0),
        ("7", True, True, 5, True, "approve", 0, 50, 100.0),
        ("8", True, True, 5, True, "approve", 100, 150, 100.0),
        ("9", True, True, 5, True, "approve", 68, 187, 300.0),
        ("a", True, True, 5, True, "approve", 68, 187, 300.0),
    ]
    data = [(*row, 400 if row[0] == "a" else 1920, 854) for row in data]
    out = op.item_outcomes(spark.createDataFrame(data, schema))
    got = [(r.item, r.status, r.exit_code) for r in out.orderBy("item").collect()]
    assert got == [
        ("1", "no_video", 0),
        ("2", "no_audio", 0),
        ("3", "no_transcript", 0),
        ("4", "highlight_failed", 1),
        ("5", "cancelled", 0),
        ("6", "crashed", 1),
        ("7", "bad_highlight", 0),
        ("8", "out_of_range", 1),
        ("9", "success", 0),
        ("a", "too_narrow", 1),
    ]
    assert ("success", 0, 1) in rows(op.outcome_funnel(out))


def test_discover_order(spark):
    data = [("a", 950.0, 5, 1), ("b", 1000.0, 9, 1), ("c", 10.0, 99, 1), ("d", 7200.0, 9, 3)]
    df = spark.createDataFrame(data, "url STRING, duration_s DOUBLE, view_count INT, upload_date INT")
    assert [r.url for r in op.discover(df, 900, 7200).collect()] == ["d", "b", "a"]


def test_stream_catalogue(spark):
    streams = spark.createDataFrame(
        [
            (1, 0, "video", "720p", 2097152, True),
            (1, 1, "video", "1080p", 1048576, False),
            (1, 2, "audio", None, 1000, False),
            (1, 3, "video", "480p", 1048576, False),
            (1, 4, "audio", None, 1000, False),
            (1, 5, "video", "2160p", 1048576, False),
            (1, 6, "video", "360p", 1048576, False),
            (1, 7, "video", "144p", 1048576, False),
            (2, 0, "video", "720p", 1048576, True),
            (3, 0, "audio", None, 10, False),
        ],
        "video_id LONG, stream_idx INT, type STRING, resolution STRING, filesize LONG, is_progressive BOOLEAN",
    )
    shown = op.rank_streams(streams).where("video_id = 1").orderBy("rank").collect()
    assert [(r.rank, r.resolution) for r in shown] == [
        (0, "2160p"), (1, "1080p"), (2, "720p"), (3, "480p"), (4, "360p"),
    ]
    assert shown[2].size_mb == 2.0 and shown[2].kind == "Progressive"

    def pick(answer):
        answers = spark.createDataFrame([(1, answer)], "video_id LONG, answer STRING")
        chosen = op.attach_audio(op.choose_stream(streams, answers), streams)
        return {r.video_id: (r.resolution, r.audio_idx) for r in chosen.collect()}

    # Rank 5 is not shown, but it is a legal answer; rank 6 does not exist.
    assert pick("5") == {1: ("144p", 2), 2: ("720p", None)}
    assert pick(" 2 ")[1] == ("720p", None)
    for bad in ("6", "-1", "x", "", None, "99999999999999999999"):
        assert pick(bad)[1] == ("2160p", 2)
