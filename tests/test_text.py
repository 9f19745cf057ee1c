import random

from pyspark.sql import functions as F

from clipweave import functions as fn


def one(spark, expr_of, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(expr_of(F.col("v"))).collect()]


def greedy(text, width=35):
    if len(text) <= width:
        return text
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return "\n".join(lines + [line] if line else lines)


def test_strip_takes_all_white_space(spark):
    assert one(spark, fn.strip, "\t a b  ", "", " \n ") == ["a b", "", ""]


def test_slug(spark):
    got = one(
        spark, fn.slug, 'A: "Big" [Day]?', "__under_score  and\ttab--x__", "???", "x" * 79 + " yz", "-a-"
    )
    # The cut at 80 comes last, so a trailing hyphen can come back.
    assert got == ["a-big-day", "under-score-and-tab-x", "", "x" * 79 + "-", "a"]


def test_safe_title_keeps_case(spark):
    assert one(spark, fn.safe_title, 'A|B:C/D\\E?F*G<H>I"J') == ["A-B-C-D-EFGHIJ"]


def test_title_from_path(spark):
    got = one(spark, fn.title_from_path, "/v/My.clip.mp4", "plain", ".hidden", "a/b.c/d", "..x", "a..b", "/v/")
    assert got == ["My.clip", "plain", ".hidden", "d", "..x", "a.", ""]
    got = one(spark, lambda c: fn.title_from_path(c, downloaded=True), "v/a.webm.b.webm", "v/x.mp4")
    assert got == ["a.mp4.b", "x"]


def test_output_name(spark):
    got = one(spark, lambda c: fn.output_name(c, F.lit("12ab34cd")), "My Day", "", None, "???")
    assert got == [
        "my-day_12ab34cd_short.mp4",
        "output_12ab34cd_short.mp4",
        "output_12ab34cd_short.mp4",
        "_12ab34cd_short.mp4",
    ]


def test_session_key_is_stable_and_short(spark):
    a, b, c = one(spark, lambda v: fn.session_key(v, F.lit(1)), "x", "x", None)
    assert a == b and a != c and len(a) == len(c) == 8


def test_seconds_text_matches_python(spark):
    values = [0.0, 0.5, 12.0, 1234.25, 9999999.5, 10000000.0, 123456789.125, 0.001, 0.0005, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert [r[0] for r in df.select(fn.seconds_text("v")).collect()] == [str(v) for v in values]


def test_wrap_text_sample_segments(spark):
    samples = [
        " The boat left at six, and by seven nobody on the pier could tell it from the other lights out there",
        " A short line that fits",
        "Every morning the baker counts forty loaves again",
        "Old maps show a road where the lake is now, with two inns",
        "Rain again on the roof of the station",
    ]
    got = one(spark, fn.wrap_text, *samples)
    assert got == [greedy(s) for s in samples]
    assert got[1] == samples[1]
    assert got[2] == "Every morning the baker counts\nforty loaves again"


def test_wrap_text_edges(spark):
    values = [
        "w" * 50,
        "a " + "w" * 50 + " b",
        " " * 40,
        "x" * 35 + " y",
        "x" * 34 + " y z",
        "é" * 36 + "\tq",
        "tab\tand\nnewline " * 6,
    ]
    assert one(spark, fn.wrap_text, *values) == [greedy(v) for v in values]


def test_wrap_text_random(spark):
    rng = random.Random(5)
    values = [
        " ".join("w" * rng.choice([1, 2, 3, 5, 8, 13, 30, 34, 35, 36, 60]) for _ in range(rng.randint(1, 25)))
        for _ in range(400)
    ]
    assert one(spark, fn.wrap_text, *values) == [greedy(v) for v in values]
