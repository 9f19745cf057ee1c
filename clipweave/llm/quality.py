"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import text_slices
from clipweave.llm.linear import platt, sigmoid, train_logistic, trigram_counts, unit_rows

DIM = 1024
_META = 64 + 16 + 24 + 1


def text_shape(texts: pa.Array) -> np.ndarray:
    """Per text: shares of kinds of bytes, of distinct lines, and its length in logs."""
    kinds = np.zeros(256, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:'?"), 1):
        kinds[list(chars)] = k
    kinds[128:] = 6
    rows = []
    for _, data, offsets in text_slices(texts):
        kind = kinds[data]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            n = max(1, b - a)
            share = np.bincount(kind[a:b], minlength=7) / n
            found = data[a:b].tobytes().split(b"\n")
            rows.append([*share, len(set(found)) / len(found), np.log1p(b - a) / 12])
    return np.array(rows, np.float32).reshape(-1, 9)


def text_view(texts: pa.Array) -> np.ndarray:
    counts = np.stack(list(trigram_counts(texts, DIM, False)))
    distinct = (counts > 0).sum(1) / np.minimum(np.maximum(counts.sum(1), 1), DIM)
    return np.concatenate([unit_rows(counts), text_shape(texts), distinct[:, None].astype(np.float32)], 1)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One-hot source and language (hashed) and length step; what is missing has no place set."""
    from zlib import crc32

    x = np.zeros((len(source), _META), np.float32)
    for i, (s, v, n) in enumerate(zip(source, lang, n_chars)):
        if s is not None:
            x[i, crc32(str(s).encode()) % 64] = 1
        if v is not None:
            x[i, 64 + crc32(str(v).encode()) % 16] = 1
        if n is not None and n >= 0:
            x[i, 80 + min(23, int(n).bit_length())] = 1
            x[i, 104] = np.log1p(float(n)) / 12
    return x


class CoTrained:
    """Two views that teach each other, calibrated and combined on labels neither was fitted to."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int, batch: int, sure: float):
        n = len(y)
        test = np.arange(n) % 4 == 0
        if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
            test[:] = True
        fit = ~test if not test.all() else test
        xs = [v[fit] for v in views]
        ys, ws = [y[fit], y[fit]], [np.ones(fit.sum()), np.ones(fit.sum())]
        left = np.ones(len(pools[0]), bool)
        self.given = [0, 0]
        self._fit(xs, ys, ws)
        for _ in range(rounds):
            taught = False
            for k in (0, 1):
                p_test = self._view(k, views[k][test])
                p_pool = np.where(left, self._view(k, pools[k]), 0.5)
                for label in (0, 1):
                    belief_test = p_test if label else 1 - p_test
                    belief = p_pool if label else 1 - p_pool
                    # A view may teach a class only at a confidence that its held-out labels bear out.
                    trusted = belief_test >= sure
                    if not trusted.any() or (y[test][trusted] == label).mean() < sure:
                        continue
                    chosen = np.argsort(-belief, kind="stable")[:batch]
                    chosen = chosen[belief[chosen] >= sure]
                    other = 1 - k
                    xs[other] = np.concatenate([xs[other], pools[other][chosen]])
                    ys[other] = np.concatenate([ys[other], np.full(len(chosen), label)])
                    ws[other] = np.concatenate([ws[other], np.full(len(chosen), 0.5)])
                    left[chosen] = False
                    self.given[k] += len(chosen)
                    taught |= len(chosen) > 0
            if not taught:
                break
            self._fit(xs, ys, ws)
        self.calibration = [platt(views[k][test] @ self.weights[k][0] + self.weights[k][1], y[test].astype(float)) for k in (0, 1)]
        both = np.stack([self._logit(k, views[k][test]) for k in (0, 1)], 1)
        w, b = train_logistic(both / 10, y[test].astype(float), l2=1e-3, rounds=500)
        self.combined = (w / 10, b)
        self.weights = [(w.astype(np.float32), b) for w, b in self.weights]

    def _fit(self, xs, ys, ws) -> None:
        self.weights = []
        for x, y, w in zip(xs, ys, ws):
            # Each class counts alike, so a rare class is learned too.
            even = w * np.where(y == 1, 0.5 / max((w * (y == 1)).sum(), 1e-9), 0.5 / max((w * (y == 0)).sum(), 1e-9))
            self.weights.append(train_logistic(x, y.astype(float), even, l2=1e-4))

    def _view(self, k: int, x: np.ndarray) -> np.ndarray:
        w, b = self.weights[k]
        return sigmoid(x @ w + b)

    def _logit(self, k: int, x: np.ndarray) -> np.ndarray:
        slope, shift = self.calibration[k]
        w, b = self.weights[k]
        return np.clip(slope * (x @ w + b) + shift, -30, 30)

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        both = np.stack([self._logit(k, views[k]) for k in (0, 1)], 1)
        return sigmoid(both @ self.combined[0] + self.combined[1])


def _views(batch: pa.RecordBatch, at: int = 0) -> list[np.ndarray]:
    column = lambda c: batch.column(batch.schema.names.index(c))
    return [text_view(column("text")), meta_view(*[column(c).to_pylist() for c in ("source", "lang", "n_chars")])]


def train(docs: DataFrame, labels: DataFrame, sample: int, rounds: int, batch: int, sure: float) -> CoTrained | None:
    """Fit on at most ``sample`` labelled and ``sample`` unlabelled documents (smallest id hashes).

    Half of the labelled places go to each label, so a rare one is not missed.  A repeated id counts once, with the
    least of its rows; rows without an id are scored but not learned from.
    """
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = known.where("y = 1").orderBy(order, "doc_id").limit(sample // 2).union(
        known.where("y <> 1").orderBy(order, "doc_id").limit(sample // 2).withColumn("y", F.lit(0))
    )
    free = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known, "doc_id", "left_anti").orderBy(order, "doc_id").limit(sample)
    wanted = picked.union(free.select("doc_id", F.lit(None).cast("int").alias("y")))
    met = docs.join(F.broadcast(wanted), "doc_id")  # at most twice ``sample`` ids
    joined = met.groupBy("doc_id", "y").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("_d")).select("doc_id", "y", "_d.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text, meta = _views(part)
                packed = [pa.array([r.astype(np.float16).tobytes() for r in v], pa.binary()) for v in (text, meta)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed], ["doc_id", "y", "t", "m"])

    columns = ["doc_id", "y", "text", "source", "lang", "n_chars"]
    rows = joined.select(*columns).mapInArrow(features, "doc_id long, y int, t binary, m binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["t"]))
    read = lambda some, c: np.array([np.frombuffer(r[c], np.float16) for r in some], np.float32)
    labelled, pool = [r for r in rows if r["y"] is not None], [r for r in rows if r["y"] is None]
    y = np.array([r["y"] for r in labelled])
    if len(set(y.tolist())) < 2:
        return None
    pools = [read(pool, c) if pool else np.zeros((0, read(labelled[:1], c).shape[1]), np.float32) for c in "tm"]
    return CoTrained([read(labelled, "t"), read(labelled, "m")], y, pools, rounds, batch, sure)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 3000,
    rounds: int = 4,
    batch: int = 200,
    sure: float = 0.95,
    threshold: float = 0.5,
) -> DataFrame:
    """Probability that each document is of good quality, and whether it is accepted.

    Two views: hashed trigrams and shape of the whole text; source, language and length from the
    metadata.  Each round a view gives its ``batch`` surest pseudo-labels of either class to the
    other, if its held-out labels bear out a precision of ``sure`` at that confidence.  Both
    are calibrated on held-out labels and combined there.  Fitted on bounded samples (``sample``
    labelled and as many unlabelled documents); all documents are scored in one pass without a shuffle.

    Null text or one of white space only: score 0, rejected.  Null metadata: nothing set in that
    view.  Documents with several labels: the worst counts.  Without both labels everything
    with text is accepted at score 0.5.  Repeated rows get equal answers.  Empty input: no rows.

    Returns doc_id, score, accepted.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.col("n_chars").cast("long"),
    )
    model = train(narrow, labels, sample, rounds, batch, sure)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                said = model.score(_views(part)) if model is not None else np.full(part.num_rows, 0.5)
                blank = np.array([not t or t.isspace() for t in part.column(1).to_pylist()], bool)
                said = np.where(blank, 0.0, said).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(said), pa.array((said >= threshold) & ~blank)], ["doc_id", "score", "accepted"]
                )

    return narrow.mapInArrow(score, "doc_id long, score double, accepted boolean")
