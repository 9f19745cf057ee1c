"""Exact top-k inner products by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import keep, runs
from clipweave.llm.vectors import batches_of, best, blocks, matrix, top, usable

LEVELS = 256
#: Impacts, as parts of the largest one, down to which segments are read in turn.
ROUNDS = (0.5, 0.2, 0.0)
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class ImpactIndex:
    """Postings of a block of integer vectors: per component, rows in descending value.

    Rows of one component whose values share a level form a segment; ``start[d, l]`` is the
    number of rows with a level above ``l``, so the segments above or below any level are one slice.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, self.width = rows.shape
        lo, hi = int(rows.min(initial=0)), int(rows.max(initial=0))
        self.shift = max(0, int(hi - lo).bit_length() - int(LEVELS).bit_length() + 1)
        self.base = lo
        level = (rows - lo) >> self.shift
        self.levels = int(level.max(initial=0)) + 1
        by_value = np.argsort(-rows, axis=0, kind="stable")
        self.order = np.ascontiguousarray(by_value.T)
        self.value = np.ascontiguousarray(np.take_along_axis(rows, by_value, 0).T.astype(np.float64))
        counts = np.zeros((self.width, self.levels + 1), np.int64)
        np.add.at(counts, (np.repeat(np.arange(self.width), n), level.T.ravel()), 1)
        # start[d, l]: rows of component d whose level is at least l.
        self.start = np.concatenate([counts[:, ::-1].cumsum(1)[:, ::-1], np.zeros((self.width, 1), np.int64)], 1)

    def _cut(self, q: np.ndarray, impact: float) -> tuple[np.ndarray, np.ndarray]:
        """Per component: the level from which on all contributions can reach ``impact``, and a
        bound of the contributions beyond it."""
        edge = np.divide(impact, q, out=np.zeros(len(q)), where=q != 0)
        at = np.clip(np.floor((edge - self.base) / (1 << self.shift)).astype(np.int64), -1, self.levels)
        up = np.clip(at, 0, self.levels)  # q > 0: levels at or above
        down = np.clip(at + 1, 0, self.levels)  # q < 0: levels below ``down``
        cut = np.where(q > 0, up, down)
        below = self.base + (up << self.shift) - 1
        above = self.base + (down << self.shift)
        bound = np.where(q > 0, q * below, q * above)
        return cut, np.where(q == 0, 0, bound)

    def search(self, q: np.ndarray, k: int, floor: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows (without id ``own``), or of those that reach ``floor``.

        Segments are read by descending quantised impact, in steps.  A row's score is at most what
        it has collected plus the largest impact left in each component.  A row that cannot reach
        the ``k``-th best score known is out for good.  Reading stops as soon as few rows are left,
        at the latest at impact 0, where what is unread can only lower a score; the rows that
        remain possible are rescored exactly.
        """
        n = len(self.ids)
        q = q.astype(np.int64)
        live = np.flatnonzero(q)
        up = q > 0
        collected = np.zeros(n)
        none = np.iinfo(np.int64).min
        known = none if floor is None else floor
        peak = float(np.max(np.where(up, q * self.value[:, 0], q * self.value[:, -1]), initial=0))
        done = np.where(up, 0, n)  # postings read: from the front up to here, or from here to the back
        possible = np.arange(n)
        for part in ROUNDS:
            cut, bound = self._cut(q, peak * part)
            reach = np.take_along_axis(self.start, np.clip(cut, 0, self.levels)[:, None], 1)[:, 0]
            lo, hi = np.where(up, done, reach), np.where(up, reach, done)
            for d in live[hi[live] > lo[live]].tolist():
                at = slice(lo[d], hi[d])
                collected[self.order[d, at]] += q[d] * self.value[d, at]
            done = np.where(up, np.maximum(done, reach), np.minimum(done, reach))
            # Exact scores of the rows that have collected most raise the known k-th best.
            lead = np.argpartition(-collected, min(k, n - 1))[: k + 1]
            lead = lead[self.ids[lead] != own]
            if len(lead) >= k:
                known = max(known, int(np.sort(self.rows[lead].astype(np.int64) @ q)[-k]))
            if known != none:
                possible = np.flatnonzero(collected + float(np.maximum(bound[live], 0).sum()) >= known)
            if len(possible) <= max(4 * k, n // 16):
                break
        exact = self.rows[possible].astype(np.int64) @ q
        ok = (self.ids[possible] != own) & (exact >= known if known != none else True)
        possible, exact = possible[ok], exact[ok]
        at = top(exact, self.ids[possible], k)
        return self.ids[possible[at]], exact[at]


def _search_blocks(queries: DataFrame, rows: DataFrame, width: int, k: int) -> DataFrame:
    """Every query against every block of rows: one bounded group for each pair of blocks."""
    n_q = (queries.agg(F.max("q_block")).first()[0] or 0) + 1
    n_c = (rows.agg(F.max("block")).first()[0] or 0) + 1
    first = rows.agg(F.min("block")).first()[0] or 0
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(n_c - 1)))).select(
        "q_block", "block", F.lit(1).alias("role"), "vec_id", "floor", "v"
    )
    right = rows.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select(
        "q_block", "block", F.lit(0).alias("role"), "vec_id", F.lit(None).cast("long").alias("floor"), "v"
    )
    met = left.union(right).repartition("q_block", "block").sortWithinPartitions("q_block", "block", "role", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["q_block", "block"]):
            role, ids = t.column("role").to_numpy(), t.column("vec_id").to_numpy()
            v = matrix(t.column("v"), np.int64, width)
            split = int((role == 0).sum())
            if split == 0:
                continue
            index = ImpactIndex(ids[:split], v[:split])
            floors = t.column("floor").to_pylist()
            out = []
            for i in range(split, len(ids)):
                found, score = index.search(v[i], k, floors[i], ids[i])
                out.append((np.full(len(found), ids[i]), found, score))
            yield from batches_of(out, _OUT)

    return met.mapInArrow(search, "query_id long, vec_id long, score long")


def exact_top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = 4096, query_rows: int = 1024
) -> DataFrame:
    """The ``k`` largest integer inner products of each query row with all other rows, exactly.

    Components become floor(scale * x).  Queries are the rows whose id is divisible by ``every``.
    Rows are dealt to blocks of about ``block_rows``, queries to blocks of ``query_rows``; each
    pair of blocks is one bounded task unit with its own index.  The first eighth of the blocks
    (at least one) is searched first; the k-th best score found there is a proven floor under
    which other blocks need not look, and under which they emit nothing.

    Vectors that are null or hold null, NaN or infinite components take no part.  Shorter vectors
    count as padded with zeros; an empty vector scores 0.  Scores are exact as long as they and
    their partial sums stay below 2**53.  A row never finds its own id, so copies under one id do
    not find each other; rows repeated under one id are one candidate.  Ties go to smaller ids.
    Empty input: no rows.  Other columns are ignored.

    Returns query_id, rank (from 1), vec_id, score.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    ready = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(
        usable("embedding") & F.col("vec_id").isNotNull()
    )
    ready = keep(ready.select("vec_id", whole.alias("v")).distinct(), "impacts")
    n, width = ready.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_blocks = max(1, -(-n // block_rows))
    rows = blocks(ready, n_blocks, "block")
    queries = ready.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    queries = blocks(queries, -(-n // (every * query_rows)), "q_block").withColumn("floor", F.lit(None).cast("long"))
    seed = max(1, n_blocks // 8)
    start = keep(best(_search_blocks(queries, rows.where(F.col("block") < seed), width or 1, k), k), "start")
    if seed == n_blocks:
        return start
    floors = start.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floored = queries.drop("floor").join(floors, queries["vec_id"] == F.col("query_id"), "left").drop("query_id")
    rest = _search_blocks(floored, rows.where(F.col("block") >= seed), width or 1, k)
    return best(start.select("query_id", "vec_id", "score").union(rest), k)
