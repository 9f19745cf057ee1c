"""Decontamination against all windows of all texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clipweave.llm import winnowing as W
from clipweave.llm.queries import QUERIES


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        clash = ("key", "k", "s", "len", "window", "items", "set", "n_words", "prints", "_words", "g")
        d = d.select("*", *[F.lit("x").alias(c) for c in clash])
        b = b.select("*", *[F.lit("x").alias(c) for c in clash], F.lit("x").alias("item"))
    counted, passages = W.decontaminate(d, b)
    return sorted((tuple(r) for r in W.digest(counted).collect()), key=repr), passages


def test_query_equals_all_windows(spark, sf_dir):
    take = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()]
    want = plain(take("documents", "doc_id"), take("benchmark", "item_id"))
    found = QUERIES["op12_winnowing"](spark, sf_dir)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_small_vocabulary_equals_all_windows(spark, seed):
    """Few words: repeats, periodic texts, windows of several items, items shorter than a window."""
    rng = random.Random(seed)
    text = lambda n, v: " ".join(rng.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(i % 12, text(rng.choice([1, 2, 5, 9, 10, 11, 14, 30] if seed else [10, 11, 14, 30]), rng.choice([2, 3, 8]))) for i in range(20)]
    docs = [(i, text(rng.randint(0, 80), rng.choice([1, 2, 3, 8]))) for i in range(60)]
    docs += [(100 + i, f"{text(5, 8)} {rng.choice(items)[1]} {text(3, 8)}") for i in range(30)]
    got, _ = run(spark, docs, items)
    assert got == plain(docs, items)


def test_edges(spark):
    passage = "One two THREE four-five six seven eight nine ten eleven"
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "?!"), (None, "é x Ü9 ß"), (10, passage + " twelve"), (2, "lone")]
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " .\x00"), (None, passage.lower()), (None, "no hit"), (5, passage[:-7]), (6, long + " " + passage)]
    docs += [(7, "É X ü9 SS"), (7, "é x ü9 ss"), (7, "é, X\x7f\nÜ9 ß"), (8, "a LONE wolf"), (9, passage + " . " + passage)]
    docs += [(11, passage)] * 40
    got, passages = run(spark, docs, items)
    assert got == plain(docs, items)
    got, _ = run(spark, docs, items, extra=True)
    assert got == plain(docs, items)
    found = {(r["doc_id"], r["first"], r["n_words"]) for r in passages.collect()}
    assert (6, 30_000, 11) in found and (9, 0, 22) in found
    assert run(spark, docs, [])[0] == plain(docs, [])
    assert run(spark, [], items)[0] == []


def test_prints_have_the_winnowing_guarantee(spark):
    """Texts that share one window share a print; about two prints in seven words."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(10)]
    rows = [(" ".join([f"w{rng.random()}" for _ in range(300)] + shared + [f"w{rng.random()}" for _ in range(300)]),) for _ in range(8)]
    found = W.with_fingerprints(spark.createDataFrame(rows, "text string"), "text").collect()
    common = set.intersection(*[{p["g"] for p in r["prints"]} for r in found])
    assert len(common) >= 1
    assert all(0.22 < len(r["prints"]) / r["n_words"] < 0.36 for r in found)


def test_main_path_is_native(spark, sf_dir):
    plan = QUERIES["op12_winnowing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)
