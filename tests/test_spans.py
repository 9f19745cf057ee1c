import random

import pytest
from pyspark.sql import functions as F

from clipweave import operators as op
from tests.conftest import rows

SEG = "video_id INT, seg_idx INT, text STRING, start_s DOUBLE, end_s DOUBLE"
SPAN = "video_id INT, first_idx INT, last_idx INT, start_s DOUBLE, end_s DOUBLE"


def talk(seed, n, video=1):
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        length = rng.choice([1.5, 3.0, 4.2, 8.0])
        text = f" word{i}" + rng.choice([".", "?", "!", ",", "", ". "])
        out.append((video, i, text, round(t, 1), round(t + length, 1)))
        t += length + rng.choice([0, 0, 0.5])
    return out


def closes(text):
    return text.rstrip().endswith((".", "!", "?"))


def test_candidates_against_brute_force(spark):
    segs = talk(1, 250) + talk(2, 90, 2) + talk(3, 3, 3)
    by_video = {}
    for s in segs:
        by_video.setdefault(s[0], []).append(s)
    want = []
    for v, list_ in by_video.items():
        for i, a in enumerate(list_):
            if i and not closes(list_[i - 1][2]):
                continue
            for b in list_[i:]:
                if closes(b[2]) and 50.0 <= b[4] - a[3] <= 70.0:
                    want.append((v, a[1], b[1], a[3], b[4], b[4] - a[3]))
    got = op.candidate_spans(spark.createDataFrame(segs, SEG), target_s=60.0, tol_s=10.0)
    assert len(want) > 200 and rows(got) == sorted(want)


def test_edges_across_chunks(spark, monkeypatch):
    from clipweave.operators import spans

    monkeypatch.setattr(spans, "SEG_CHUNK", 4)
    segs = talk(4, 50)
    got = rows(op.sentence_edges(spark.createDataFrame(segs, SEG)).select("seg_idx", "opens", "closes"))
    assert got == [(s[1], s[1] == 0 or closes(segs[s[1] - 1][2]), closes(s[2])) for s in segs]


def test_text_of_best_span(spark):
    segs = talk(5, 300)
    df = spark.createDataFrame(segs, SEG)
    best = op.best_span(op.candidate_spans(df), -F.abs(F.col("span_s") - 120))
    r = op.span_text(best, df).first()
    assert r.content == " ".join(s[2].strip() for s in segs[r.first_idx : r.last_idx + 1])
    assert abs(r.span_s - 120) <= 10


def greedy(spans, score):
    kept = []
    tie = lambda s: (s[1] * 2654435761 + s[2] * 40503) % 2**32
    for s in sorted(spans, key=lambda s: (-score(s), tie(s), s[1], s[2])):
        if all(not (s[0] == k[0] and s[3] < k[4] and k[3] < s[4]) for k in kept):
            kept.append(s)
    return sorted(kept)


@pytest.mark.parametrize("chunk_s", [300.0, 1000.0, 1e6])
@pytest.mark.parametrize("kind", ["varied", "ties", "rising"])
def test_all_spans_equals_greedy_whatever_the_chunks(spark, chunk_s, kind):
    rng = random.Random(11)
    spans = []
    for i in range(600):
        s = round(rng.uniform(0, 4000), 1)
        spans.append((1 if i % 4 else 2, i, i + rng.randint(1, 9), s, round(s + rng.uniform(110, 130), 1)))
    length = lambda s: -abs(s[4] - s[3] - 120)
    score = {"varied": length, "ties": lambda s: 0.0, "rising": lambda s: s[3]}[kind]
    column = {
        "varied": -F.abs(F.col("end_s") - F.col("start_s") - 120),
        "ties": F.lit(0.0),
        "rising": F.col("start_s"),
    }[kind]
    got = op.all_spans(spark.createDataFrame(spans, SPAN), column, chunk_s=chunk_s).drop("score")
    assert rows(got) == greedy(spans, score)


def test_all_spans_longer_than_half_a_chunk(spark):
    spans = [(1, i, i, float(i * 50), float(i * 50 + 120)) for i in range(20)]
    got = op.all_spans(spark.createDataFrame(spans, SPAN), F.lit(0.0), chunk_s=100.0).drop("score")
    assert rows(got) == greedy(spans, lambda s: 0.0)


def test_even_segments_in_a_long_video_need_few_rounds(spark, monkeypatch):
    """All lengths equal, so all scores tie over hundreds of chunks."""
    frame, rounds = type(spark.range(1)), []
    real = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: rounds.append(1) or real(self, *a))
    spans = spark.range(20000).select(
        F.lit(1).alias("video_id"),
        F.col("id").cast("int").alias("first_idx"),
        (F.col("id") + 19).cast("int").alias("last_idx"),
        (F.col("id") * 6.0).alias("start_s"),
        (F.col("id") * 6.0 + 119.5).alias("end_s"),
    )
    got = op.all_spans(spans, F.lit(0.0), chunk_s=3600.0).select("start_s", "end_s").orderBy("start_s").collect()
    assert len(rounds) <= 6
    assert all(a.end_s <= b.start_s for a, b in zip(got, got[1:])) and len(got) > 600


def test_single(spark):
    spans = [(1, 0, 1, 0.0, 120.0), (1, 5, 9, 200.0, 319.0), (2, 0, 4, 3.0, 120.0)]
    got = op.all_spans(spark.createDataFrame(spans, SPAN), F.col("start_s"), single=True)
    assert [(r.video_id, r.first_idx) for r in got.orderBy("video_id").collect()] == [(1, 5), (2, 0)]
