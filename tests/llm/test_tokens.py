"""Packing and token attribution against the tokenizers library."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clipweave.llm import attribution, packing
from clipweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(reference, text):
    return np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_packing(rows, docs, reference, capacity=2048):
    """Round trip: pieces give back every document; sequences are gapless and fit."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of) == set(docs)
    for doc, text in docs.items():
        ids, at = ids_of(reference, text), 0
        for k, r in enumerate(sorted(of[doc], key=lambda r: r["piece"])):
            assert r["piece"] == k and r["start"] == at and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(of[doc]) == 1)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_packing_query_round_trip(spark, sf_dir, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, tokens = check_packing(QUERIES["op7_residual_packing"](spark, sf_dir).collect(), docs, reference)
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_packing_through_several_levels(spark, reference):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.choice((3, 9, 20, 31, 33, 40, 64, 130))))) for i in range(900)]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|> é 日本"), (1003, " " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, offset string")
    found = packing.pack(df, capacity=64, slack=2, group_items=64).collect()
    n, tokens = check_packing(found, dict(rows), reference, 64)
    assert n <= 1.1 * tokens / 64
    assert packing.pack(df.limit(0)).count() == 0


def test_items_that_never_share_a_bin_stay_in_groups(spark, reference):
    rows = [(i, " ".join(["word"] * 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check_packing(packing.pack(df, capacity=64, group_items=32).collect(), dict(rows), reference, 64)[0] == 400


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    rng = random.Random(7)
    sizes = sorted((rng.randint(1, 100) for _ in range(2000)), reverse=True)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    free, slow = [], []
    for i, s in enumerate(sizes):
        fit = [f for f in free if f[0] >= s]
        best = min(fit, key=lambda f: f[0], default=None)
        if best is None:
            free.append([100 - s])
        else:
            best[0] -= s
    assert len(bins) == len(free)


TEXTS = ["", None, "a", "One line.\nTwo  lines\n\n  é日本語 ok\n", "\n\n", "no break " * 50, "ünïcödé\n" * 30, "x\r\ny z\t\n 12345"]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_spans_equal_the_librarys_offsets(reference, text):
    first, end = attribution.token_spans(text)
    offsets = reference.encode(text, add_special_tokens=False).offsets
    assert [(a, b) for a, b in zip(first.tolist(), end.tolist())] == offsets


@pytest.mark.parametrize("rule", attribution.RULES)
def test_join_equals_all_token_section_pairs(rule):
    rng = random.Random(4)
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, 60), 20))
        first, end = np.array([0] + cuts), np.array(cuts + [60])
        spans = [tuple(sorted((rng.randint(0, 60), rng.randint(0, 60)))) for _ in range(8)]
        lo, hi = np.array(spans).T
        counts, crossing = attribution.join_spans(first, end, lo, hi, rule)
        for k, (a, b) in enumerate(spans):
            want, cross = 0.0, 0
            for s, e in zip(first, end):
                common = min(e, b) - max(s, a)
                if b > a and common > 0:
                    cross += s < a or e > b
                    want += {"first": a <= s < b, "last": a <= e - 1 < b, "share": common / (e - s)}[rule]
            assert abs(counts[k] - want) < 1e-9 and crossing[k] == cross


def test_section_query_adds_up(spark, sf_dir, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    total = defaultdict(float)
    rows = QUERIES["op9_section_tokens"](spark, sf_dir).collect()
    for r in rows:
        total[r["doc_id"]] += r["tokens"]
    assert total == {d: len(ids_of(reference, t)) - 1 for d, t in docs.items()}
    got = defaultdict(dict)
    for r in rows:
        got[r["doc_id"]][r["section"]] = (r["start"], r["end"])
    for d, t in docs.items():
        assert "".join(t[a:b] for _, (a, b) in sorted(got[d].items())) == t


def test_section_edges(spark):
    rows = [(i, t, [(0, 2), (5, 3), None, (1, 10**9)], "x") for i, t in enumerate(TEXTS)] + [(99, "abc", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:long,end:long>>, section string")
    plain = attribution.section_tokens(df).collect()
    assert {(r["section"], r["tokens"]) for r in plain if r["doc_id"] < 2} == {(None, 0.0)}
    for rule in attribution.RULES:
        found = attribution.section_tokens(df, "parts", rule).collect()
        assert len([r for r in found if r["doc_id"] == 3]) == 4 and not [r for r in found if r["doc_id"] == 99]
    assert attribution.section_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        attribution.section_tokens(df, rule="middle")


def test_repeated_and_null_ids_spread_over_groups(spark):
    """A third of the rows are copies of one document, a third have no id: no group takes them all."""
    rows = [(1, "same words here again")] * 300 + [(None, f"no id {i}") for i in range(300)] + [(i, "other " * (i % 9)) for i in range(10, 310)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(df, capacity=64, slack=2, group_items=64).collect()
    assert len(found) == len(rows)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    of_copies = [s for s, m in bins.items() if any(r["doc_id"] == 1 for r in m)]
    assert len(of_copies) >= 300 * 5 // 64 and len(bins) <= 1.1 * sum(r["length"] for r in found) / 64 + 2
