"""Vectors as Arrow matrices, shared by the two vector searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def blocks(df: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """Deal rows to ``n_blocks`` blocks of nearly equal size by a hash of their id."""
    return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(max(n_blocks, 1))).cast("int"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best scores of each query, ties to smaller ids; the limit also runs before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def batches_of(rows: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [np.concatenate(c) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
