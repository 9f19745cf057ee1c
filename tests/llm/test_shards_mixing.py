"""Hilbert shards and Poisson mixing."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clipweave.llm import mixing, shards
from clipweave.llm.queries import QUERIES


def test_curve_visits_every_cell_in_unit_steps(spark):
    for n, bits in ((2, 3), (3, 2), (3, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
        axes = [F.col(f"c{i}") for i in range(n)]
        path = [tuple(r)[:n] for r in df.select(*axes, shards.hilbert_index(axes, bits).alias("h")).orderBy("h").collect()]
        found = sorted(r["h"] for r in df.select(shards.hilbert_index(axes, bits).alias("h")).collect())
        assert found == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def check_rows_law(rows, n_shards=24):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query_over_all_documents(spark, sf_dir):
    out = QUERIES["op2_hilbert_shards"](spark, sf_dir)
    rows = out.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_rows_law(rows)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        assert r["law"] == "rows" and r["grown_shard"] is None
    order = sorted((r["shard"], r["slot"], r["curve"]) for r in rows)
    assert [c for _, _, c in order] == sorted(c for _, _, c in order)


def test_runs_prune(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bounds = shards.shard_bounds(shards.hilbert_shards(docs, 8), docs).collect()
    points = [tuple(r) for r in docs.select("lang", "source", "n_chars").distinct().collect()]
    names = ("lang", "source", "n_chars")
    read = sum(all(b[f"min_{c}"] <= v <= b[f"max_{c}"] for c, v in zip(names, p)) for b in bounds for p in points)
    assert read < 0.5 * len(points) * len(bounds)


def test_shards_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, _at string"
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "en", None, -5, None, None)]
    rows += [(3, "é" * 50000, "en", "hot", 50000, None, None)] * 3 + [(i, "x", "en", "hot", 1, None, None) for i in range(10, 700)]
    df = spark.createDataFrame(rows, schema)
    found = shards.hilbert_shards(df, 24, bucket_rows=16).collect()
    assert len(found) == len(rows)
    check_rows_law(found)
    assert {(r["doc_id"], r["size"]) for r in found if r["doc_id"] < 4} == {(1, 8), (2, 8), (3, 100008)}
    assert shards.hilbert_shards(df.limit(0)).count() == 0
    assert "Python" not in shards.hilbert_shards(df)._jdf.queryExecution().toString()


def expected_copies(doc_id, mean, seed=17):
    import hashlib

    u = int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing_query_equals_inversion_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    n = Counter(r["source"] for r in docs)
    norm = sum(math.sqrt(v) for v in n.values())
    mean = {s: math.sqrt(v) / norm * len(docs) / v for s, v in n.items()}
    want = {r["doc_id"]: expected_copies(r["doc_id"], mean[r["source"]]) for r in docs}
    rows = QUERIES["op5_poisson_mix"](spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({k: v for k, v in want.items() if v})
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)


def test_mixing_query_carries_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r["doc_id"]: tuple(r) for r in docs.collect()}
    out = QUERIES["op5_poisson_mix"](spark, sf_dir)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    rows = out.select(*docs.columns).collect()
    assert rows and all(tuple(r) == given[r["doc_id"]] for r in rows)


def test_mixing_hits_targets_and_means(spark):
    rows = [(i, "hot" if i % 3 else "a" if i % 2 else None) for i in range(60000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("copy", F.lit("x"))
    out = mixing.poisson_mix(df, {"hot": 1.0, "a": 3.0}, total=80000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] / 20000 - 1) < 0.03 and abs(n["a"] / 60000 - 1) < 0.03 and None not in n
    spread = out.groupBy("doc_id", "source").count().where("source = 'a'").agg(F.variance("count")).first()[0]
    assert abs(spread / 6.0 - 1) < 0.1
    large = mixing.poisson_mix(df.where("source = 'a'").limit(200), {"a": 1.0}, total=200 * 900)
    assert abs(large.count() / (200 * 900) - 1) < 0.02


def test_large_means_store_no_long_distribution(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(1, 20001)] + [(0, "small")], "doc_id long, source string")
    table = {r["_key"]: r for r in mixing.mixture(df).collect()}
    assert table["small"]["mean"] > 100 and all(len(r["cdf"] or []) <= 127 for r in table.values())
    rows = mixing.poisson_mix(df).where("doc_id < 50").collect()
    want = {i: expected_copies(i, table["hot" if i else "small"]["mean"]) for i in range(50)}
    assert Counter(r["doc_id"] for r in rows) == Counter({k: v for k, v in want.items() if v})


def test_mixing_edges(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, source string")
    found = Counter(r["doc_id"] for r in mixing.poisson_mix(df, total=30).collect())
    assert found[1] % 2 == 0
    assert mixing.poisson_mix(df.limit(0)).count() == 0
    assert mixing.poisson_mix(df, {"x": 1.0}).count() == 0
    joined = mixing.poisson_mix(df, total=30, broadcast_sources=0)
    assert Counter(r["doc_id"] for r in joined.collect()) == found
