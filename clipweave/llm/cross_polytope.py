"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import keep, runs
from clipweave.llm.vectors import batches_of, best, matrix, top, usable

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two wide), orthonormal."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """Hash tables over ``width`` dimensions with about ``n_buckets`` buckets each.

    A table's hash is one or more cross-polytopes: the vector is turned by three random sign
    flips and Hadamard transforms, and goes to the nearest of the signed first ``axes`` axes.
    """

    def __init__(self, width: int, n_tables: int, n_buckets: int, seed: int = 7):
        self.width = max(2, 1 << (max(width, 1) - 1).bit_length())
        self.axes, left = [], max(2, 1 << max(0, (n_buckets - 1).bit_length()))
        while left > 1:
            axes = min(self.width, max(1, left // 2))
            self.axes.append(axes)
            left //= 2 * axes
        self.n_tables = n_tables
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (n_tables, len(self.axes), 3, self.width))

    @property
    def n_buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes]))

    def _turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        if x.shape[1] < self.width:
            x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        x = x[:, : self.axes[part]]
        return np.concatenate([x, -x], 1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for part, axes in enumerate(self.axes):
            out = out * (2 * axes) + self._turned(x, table, part).argmax(1)
        return out

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` most likely buckets of each row, best first: least squared loss over the parts."""
        cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for part, axes in enumerate(self.axes):
            near = self._turned(x, table, part)
            loss = (near.max(1, keepdims=True) - near) ** 2
            sums = (cost[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            codes = (code[:, :, None] * (2 * axes) + np.arange(2 * axes)).reshape(len(x), -1)
            at = np.argsort(sums, 1, kind="stable")[:, :n]
            cost, code = np.take_along_axis(sums, at, 1), np.take_along_axis(codes, at, 1)
        return code


def _hashed(df: DataFrame, model: CrossPolytope, n_probes: int, width: int, carry: bool = True) -> DataFrame:
    """Rows times tables times probes with their bucket; one probe is the row's own bucket.

    Without ``carry`` the buckets alone, for counts.
    """
    schema = pa.schema([("tab", pa.int32()), ("bucket", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float32()))])
    bare = pa.schema(list(schema)[:2])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column(1), np.float64, width)
                ids, v = part.column(0), part.column(2)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for tab in range(model.n_tables):
                    code = model.buckets(unit, tab)[:, None] if n_probes == 1 else model.probes(unit, tab, n_probes)
                    placed = [pa.array(np.full(code.size, tab, np.int32)), pa.array(code.ravel())]
                    if not carry:
                        yield pa.RecordBatch.from_arrays(placed, schema=bare)
                        continue
                    again = pa.array(np.repeat(np.arange(len(x)), code.shape[1]))
                    yield pa.RecordBatch.from_arrays([*placed, ids.take(again), v.take(again)], schema=schema)

    three = df.select("vec_id", "u", "v")
    return three.mapInArrow(place, "tab int, bucket long" + (", vec_id long, v array<float>" if carry else ""))


def _calibrate(
    queries: DataFrame,
    rows: DataFrame,
    model: CrossPolytope,
    width: int,
    k: int,
    recall: float,
    sample: int,
    max_probes: int,
) -> int | None:
    """Smallest number of probes a table at which a bounded sample of queries finds ``recall`` of its truth.

    None if ``max_probes`` do not reach it.  ``sample`` queries (smallest hashes of their ids) are compared with all rows, block by
    block; the probe at which each true neighbour shows up is all that reaches the driver.
    """
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "u", "v").collect()
    if not chosen:
        return 1
    q_id = np.array([r["vec_id"] for r in chosen])
    q_v = np.zeros((len(chosen), width))
    q_u = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        q_v[i, : len(r["v"])], q_u[i, : len(r["u"])] = r["v"], r["u"]
    q_u /= np.linalg.norm(q_u, axis=1, keepdims=True)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            scores = q_v @ matrix(batch.column(2), np.float64, width).T
            for i in range(len(q_id)):
                other = ids != q_id[i]
                s, d = scores[i][other], ids[other]
                if i in kept:
                    s, d = np.r_[kept[i][0], s], np.r_[kept[i][1], d]
                at = top(s, d, k)
                kept[i] = (s[at], d[at])
        yield from batches_of([(np.full(len(s), q_id[i]), d, s) for i, (s, d) in kept.items()], _OUT)

    exact = best(rows.select("vec_id", "u", "v").mapInArrow(truth, "query_id long, vec_id long, score double"), k)
    limit = min(model.n_buckets, max_probes)
    orders = [model.probes(q_u, tab, limit) for tab in range(model.n_tables)]
    place = {int(q): i for i, q in enumerate(q_id)}

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([place[q] for q in batch.column(0).to_pylist()], dtype=np.int64)
            u = matrix(batch.column(1), np.float64, width)
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            first = np.full(len(at), limit + 1, np.int64)
            for tab in range(model.n_tables):
                hit = orders[tab][at] == model.buckets(u, tab)[:, None]
                first = np.minimum(first, np.where(hit.any(1), hit.argmax(1) + 1, limit + 1))
            yield pa.RecordBatch.from_arrays([pa.array(first)], ["probe"])

    found = exact.join(rows.select("vec_id", "u"), "vec_id").select("query_id", "u").mapInArrow(ranks, "probe long")
    probes = np.sort([r["probe"] for r in found.collect()])
    if not len(probes):
        return 1
    needed = int(probes[min(len(probes) - 1, int(np.ceil(recall * len(probes))) - 1)])
    return needed if needed <= limit else None


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    n_tables: int = 6,
    bucket_rows: int = 256,
    recall: float = 0.95,
    sample: int = 64,
    chunk: int = 1024,
    max_probes: int = 4096,
) -> DataFrame:
    """Each query row's ``k`` nearest rows by inner product, among the candidates of all its probes.

    Every row is indexed in ``n_tables`` tables of about ``rows / bucket_rows`` buckets.  Largest
    inner product becomes nearest direction by one more component, sqrt(M**2 - |x|**2) for rows
    (M: the largest norm) and 0 for queries.  Queries are the rows whose id is divisible by
    ``every``; each visits the probes of a table that lose least.  Their number is set on
    ``sample`` queries, compared with all rows, so that they reach ``recall`` (contract: 0.9).
    If ``max_probes`` a table do not reach it there (possible only with more buckets than that, so
    above about ``max_probes * bucket_rows`` rows), all queries are compared with all rows instead.
    Buckets with more than ``chunk`` rows or more than ``chunk`` visiting queries are split on either
    side, and every part of rows meets every part of queries in one bounded group.  Within a group, scores are computed in double precision on the original vectors; the best k go on.
    Queries that found fewer than k rows are compared with all rows, in blocks.

    Vectors that are null, zero or hold null or non-finite components take no part; shorter ones
    count as padded with zeros.  Ties go to smaller ids.  Repeated rows (same id) are one row.  A
    row never finds its own id.  Empty input: no rows.  Other columns are ignored.

    Returns query_id, rank (from 1), vec_id, score.
    """
    ready = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("v")).where(
        usable("v") & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0)
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ready = keep(ready.distinct().withColumn("norm2", square), "vectors")
    n, width, top2 = ready.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm2")).first()
    if not n:
        return ready.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    padded = F.concat(F.col("v").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    lift = F.sqrt(F.greatest(F.lit(float(top2)) - F.col("norm2"), F.lit(0.0)))
    rows = ready.select("vec_id", F.array_append(padded, lift).alias("u"), "v")
    queries = ready.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("vec_id", padded.alias("u"), "v")
    # Without a difference in norms the extra component is zero everywhere and needs no axis.
    flat = ready.where(F.col("norm2") < top2 * (1 - 1e-5)).limit(1).count() == 0
    if flat:
        rows = ready.select("vec_id", padded.alias("u"), "v")
    inner = width if flat else width + 1
    model = CrossPolytope(inner, n_tables, max(2, n // bucket_rows))
    n_probes = _calibrate(queries, rows, model, inner, k, recall, sample, max_probes)
    if n_probes is None:
        return _all_rows(queries.select("vec_id", "v"), ready, width, k)

    indexed = keep(_hashed(rows, model, 1, inner), "index")
    size = lambda name: F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name)
    visits = _hashed(queries, model, max(2, n_probes), inner, carry=False).groupBy("tab", "bucket").agg(size("q_parts"))
    parts = keep(indexed.groupBy("tab", "bucket").agg(size("parts")).join(visits, ["tab", "bucket"]), "parts")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = indexed.join(parts, ["tab", "bucket"]).select(
        "tab", "bucket", deal("parts").alias("part"), each("q_parts").alias("q_part"), F.lit(0).alias("role"), "vec_id", "v"
    )
    asked = _hashed(queries, model, max(2, n_probes), inner).join(parts, ["tab", "bucket"]).select(
        "tab", "bucket", each("parts").alias("part"), deal("q_parts").alias("q_part"), F.lit(1).alias("role"), "vec_id", "v"
    )
    where = ["tab", "bucket", "part", "q_part"]
    met = own.union(asked).repartition(*where).sortWithinPartitions(*where, "role", "vec_id")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, where):
            role, ids = t.column("role").to_numpy(), t.column("vec_id").to_numpy()
            split = int((role == 0).sum())
            if split in (0, len(ids)):
                continue
            v = matrix(t.column("v"), np.float64, width)
            out = []
            for at in range(split, len(ids), 512):
                scores = v[at : at + 512] @ v[:split].T
                for i, s in enumerate(scores):
                    other = np.flatnonzero(ids[:split] != ids[at + i])
                    pick = other[top(s[other], ids[other], k)]
                    out.append((np.full(len(pick), ids[at + i]), ids[pick], s[pick]))
            yield from batches_of(out, _OUT)

    scored = met.mapInArrow(rerank, "query_id long, vec_id long, score double")
    found = keep(best(scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k), "found")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    short = queries.join(full.where(F.col("_n") >= min(k, n - 1)), F.col("vec_id") == F.col("query_id"), "left_anti")
    short = keep(short.select("vec_id", "v"), "short")
    if short.limit(1).count() == 0:
        return found
    return found.join(short, F.col("query_id") == short["vec_id"], "left_anti").union(_all_rows(short, ready, width, k))


def _all_rows(queries: DataFrame, rows: DataFrame, width: int, k: int, block: int = 4096, query_block: int = 512) -> DataFrame:
    """The exact way for queries whose probes come up short: every block of queries meets every block of rows."""
    n_c = max(1, -(-rows.count() // block))
    n_q = max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.select(
        deal(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), F.lit(1).alias("role"), "vec_id", "v"
    )
    right = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), deal(n_c).alias("cb"), F.lit(0).alias("role"), "vec_id", "v"
    )
    met = left.union(right).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "role", "vec_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["qb", "cb"]):
            role, ids = t.column("role").to_numpy(), t.column("vec_id").to_numpy()
            split, v, out = int((role == 0).sum()), matrix(t.column("v"), np.float64, width), []
            for i in range(split, len(ids)):
                other = np.flatnonzero(ids[:split] != ids[i])
                s = v[other] @ v[i]
                at = top(s, ids[other], k)
                out.append((np.full(len(at), ids[i]), ids[other][at], s[at]))
            yield from batches_of(out, _OUT)

    return best(met.mapInArrow(score, "query_id long, vec_id long, score double"), k)
