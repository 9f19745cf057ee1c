"""Both vector searches against brute force."""

import math

import numpy as np
import pytest

from clipweave.llm import cross_polytope, impact
from clipweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)


def brute(ids, rows, k, every):
    """query -> [(id, score)] best first, ties to smaller ids."""
    out = {}
    scores = rows @ rows.T
    for i in np.flatnonzero(ids % every == 0):
        ranked = sorted((-scores[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])
        out[int(ids[i])] = [(int(d), -s) for s, d in ranked[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_exact_query_equals_brute_force(spark, sf):
    ids, rows = table(spark, f"/root/testdata/{sf}")
    got = found(QUERIES["op1_impact_top_k"](spark, f"/root/testdata/{sf}"))
    assert got == brute(ids, np.floor(256 * rows).astype(np.int64), 5, 50)


def test_approximate_query_recall_and_scores(spark):
    sf_dir = "/root/testdata/sf0.1"
    ids, rows = table(spark, sf_dir)
    got = found(QUERIES["op6_cross_polytope"](spark, sf_dir))
    want = brute(ids, rows, 20, 20)
    place = {int(d): i for i, d in enumerate(ids)}
    hit = 0
    assert set(got) == set(want)
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, rows[place[q]] @ rows[place[d]], rel_tol=1e-12, abs_tol=1e-12) for d, s in near)
        hit += len({d for d, _ in near} & {d for d, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (100, [-1.0]), (150, [2.0, -3.0]), (3, None), (4, [nan, 1.0])]
    rows += [(5, [inf, 0.0]), (6, [None, 1.0]), (7, [0.25, 0.25]), (7, [0.25, 0.25]), (8, [-0.001, 0.0]), (None, [1.0, 1.0])]
    return [(i, v, "x", 0) for i, v in rows]


def test_exact_edges(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    ids = np.array([0, 50, 100, 150, 7, 8])
    rows = np.floor(256 * np.array([[1, 0.5], [1, 0.5], [-1, 0], [2, -3], [0.25, 0.25], [-0.001, 0]])).astype(np.int64)
    for block_rows in (1, 3):
        assert found(impact.exact_top_k(df, block_rows=block_rows)) == brute(ids, rows, 5, 50)
    assert impact.exact_top_k(df.limit(0)).count() == 0


def test_exact_with_ties_and_large_values(spark):
    rng = np.random.default_rng(5)
    rows = np.repeat(rng.normal(0, 40, (40, 6)), 5, axis=0)
    df = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(rows)], SCHEMA)
    got = found(impact.exact_top_k(df, block_rows=64))
    assert got == brute(np.arange(200), np.floor(256 * rows).astype(np.int64), 5, 50)


def test_index_stops_early_only_with_proof():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(0, 1, (4000, 16)) ** 5 * 40).astype(np.int64)
    index = impact.ImpactIndex(np.arange(4000), rows)
    for i in range(40):
        got, score = index.search(rows[i], 5, None, i)
        exact = rows @ rows[i]
        exact[i] = -(2**62)
        want = np.lexsort((np.arange(4000), -exact))[:5]
        assert got.tolist() == want.tolist() and score.tolist() == exact[want].tolist()


def test_approximate_edges(spark):
    df = spark.createDataFrame(odd_rows() + [(20, [0.0, 0.0], "x", 0), (40, [], "x", 0)], SCHEMA)
    got = found(cross_polytope.nearest(df))
    ids = np.array([0, 50, 100, 150, 7, 8])
    rows = np.array([[1, 0.5], [1, 0.5], [-1, 0], [2, -3], [0.25, 0.25], [-0.001, 0]], np.float32).astype(np.float64)
    want = brute(ids, rows, 20, 20)
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert cross_polytope.nearest(df.limit(0)).count() == 0


def test_approximate_with_a_hot_vector_and_uneven_norms(spark):
    rng = np.random.default_rng(9)
    rows = np.r_[np.tile(rng.normal(0, 1, 8), (300, 1)), rng.normal(0, 1, (600, 8)) * rng.uniform(0.2, 2, (600, 1))]
    rows = rows.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(rows)], SCHEMA)
    got = found(cross_polytope.nearest(df, chunk=64))
    want = brute(np.arange(900), rows, 20, 20)
    hit = sum(sum(s >= w[-1][1] - 1e-9 for _, s in got[q]) for q, w in want.items())
    assert hit / (20 * len(want)) >= 0.9


def test_approximate_groups_are_bounded_on_both_sides(spark, monkeypatch):
    plain = cross_polytope.runs

    def bounded(batches, keys):
        for key, t in plain(batches, keys):
            assert t.num_rows <= 250, f"a group of {t.num_rows} rows"
            yield key, t

    monkeypatch.setattr(cross_polytope, "runs", bounded)
    rng = np.random.default_rng(9)
    rows = np.r_[np.tile(rng.normal(0, 1, 8), (400, 1)), rng.normal(0, 1, (500, 8))].astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(rows)], SCHEMA)
    got = found(cross_polytope.nearest(df, every=1, chunk=64))
    want = brute(np.arange(900), rows, 20, 1)
    hit = sum(sum(s >= w[-1][1] - 1e-9 for _, s in got[q]) for q, w in want.items())
    assert hit / (20 * len(want)) >= 0.9


def test_approximate_recall_where_probes_reach_their_limit(spark):
    rows = np.random.default_rng(4).normal(0, 1, (6000, 48)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(rows)], SCHEMA)
    got = found(cross_polytope.nearest(df, n_tables=1, bucket_rows=1, every=60))
    want = brute(np.arange(6000), rows, 20, 60)
    hit = sum(len({d for d, _ in got[q]} & {d for d, _ in w}) for q, w in want.items())
    assert hit / (20 * len(want)) >= 0.95


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = cross_polytope.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(cross_polytope.hadamard(y), x)
