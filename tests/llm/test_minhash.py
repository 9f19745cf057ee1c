"""Near duplicates against all pairs, and the edges of their contract."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clipweave.llm import minhash
from clipweave.llm.components import components, merged
from clipweave.llm.queries import QUERIES
from clipweave.llm.shingles import shingle_sets


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def set_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """All pairs that share a shingle, by plain sets and a plain union-find."""
    sets = {i: set_of(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r[0], r[1]) for r in docs], 2)
    assert got(QUERIES["op10_hyperminhash"](spark, sf_dir)) == want
    assert any(not kept for _, _, kept in want.values())


@pytest.mark.parametrize("k", [2, 5])
def test_chains_of_edits_equal_all_pairs(spark, k):
    rng = random.Random(k)
    rows, n = [], 0
    for length in (6, 12, 40, 150):
        for _ in range(6):
            text = [f"w{rng.randrange(400)}" for _ in range(length)]
            for _ in range(8):
                rows.append((n, " ".join(text)))
                n += 1
                for _ in range(max(1, length // 25)):
                    text[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df, words=k, chunk=4)) == brute(rows, k)


def test_edges(spark):
    rows = [
        (5, None, "x"), (3, "", "x"), (4, " \t\n\x0b\x0c\r ", "x"), (9, "One", "x"), (7, "oNE", "x"),
        (8, "É b", "x"), (6, "é b", "x"), (2, "a b c", "x"), (1, "A B  C", "x"), (1, "A B  C", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = minhash.near_duplicates(df, words=2)
    assert out.count() == len(rows) and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == {
        5: (0, 5, True), 3: (0, 3, True), 4: (0, 4, True), 9: (1, 7, False), 7: (1, 7, True),
        8: (1, 8, True), 6: (1, 6, True), 2: (1, 1, False), 1: (1, 1, True),
    }
    assert minhash.near_duplicates(df.limit(0), words=2).count() == 0


def test_null_ids_inside_a_group_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (3, text), (5, text), (2, text + " end"), (None, "apart b c"), (None, "apart b c"), (None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=str)
    assert found == sorted(
        [(None, 59, 2, False), (3, 59, 2, False), (5, 59, 2, False), (2, 60, 2, True)]
        + [(None, 2, None, True)] * 2 + [(None, 0, None, True)], key=str
    )


def test_long_text_and_slices():
    text = " ".join(f"w{i % 70000}" for i in range(300000))
    short = ["a b c", None, text, "", "x y", text]
    found = list(shingle_sets(pa.array(short), 2))
    assert [len(s) for s in found] == [2, 0, 70000, 0, 1, 70000]
    assert (found[2] == found[5]).all()


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(3)
    for share, n in ((0.3, 3000), (0.8, 3000), (0.95, 3000), (0.8, 9), (0.8, 90), (0.8, 450)):
        errors = []
        for _ in range(40):
            common = round(2 * n * share / (1 + share))
            pool = rng.integers(0, 2**64, 2 * n - common, np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:common], pool[n:]])
            size = np.array([n])
            est, low = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], size, size, share)
            assert est[0] >= low[0] and (n < 90 or low[0] > share - 0.2)
            errors.append(est[0] - share)
        assert abs(np.mean(errors)) < 0.02, share


def test_estimate_leaves_five_deviations():
    sig, n = np.zeros((1, minhash.REGISTERS), np.uint16), np.array([10**9])
    _, low = minhash.estimate(sig, sig, n, n, 0.8)
    assert low[0] <= 0.8 - 4.99 * (0.8 * 0.2 / minhash.REGISTERS) ** 0.5


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 500), (900, 901)]
    edges += [(b, a) for a, b in edges[::3]]
    rng.shuffle(edges)
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {v for k, v in found.items() if 100 <= k <= 160} == {100}
    assert {v for k, v in found.items() if k == 7 or 500 <= k < 560} == {7}
    assert found[900] == found[901] == 900 and len(found) == 61 + 61 + 2


def test_components_settle_and_merge_like_union_find(spark):
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(40)]
    hub = [(100 + i, 1000) for i in range(30)]
    loose = [tuple(int(x) for x in rng.integers(200, 400, 2)) for _ in range(120)]
    more = [(7, 1000), (390, 2000), (3000, 3001), (3001, 3000), (5, 5)]

    def union_find(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {x: find(x) for x in list(root)}

    given = path + hub + loose + loose[:9]
    first = components(spark.createDataFrame(given, "a long, b long"))
    want = union_find(e for e in given if e[0] != e[1])
    assert {r.node: r.component for r in first.collect()} == want
    after = merged(first, spark.createDataFrame(more, "a long, b long"))
    found = [(r.node, r.component) for r in after.collect()]
    want = union_find(e for e in given + more if e[0] != e[1])
    assert len(found) == len(set(found)) and {n: c for n, c in found if n in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_families_without_links_cost_rows_for_members_not_pairs(spark, monkeypatch):
    """Texts at a pairwise similarity of 0.76: no links, and twice the members make at most 2.2 times the rows."""
    written = {}
    plain_keep = minhash.keep

    def counting(df, name):
        out = plain_keep(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "keep", counting)
    shared = " ".join(f"s{i}" for i in range(432))
    sizes = []
    for n in (150, 300):
        rows = [(i, shared + " " + " ".join(f"o{i}x{j}" for j in range(68))) for i in range(n)]
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
        assert out.where("not kept").count() == 0
        sizes.append(dict(written))
    assert sizes[0]["active"] > 150  # the family does reach the comparison on full sets
    assert all(sizes[1][k] <= 2.2 * max(v, 100) for k, v in sizes[0].items())
