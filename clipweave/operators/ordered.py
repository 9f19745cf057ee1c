"""Ordered operators that never put a whole key into one task.

A plain window ``PARTITION BY key ORDER BY pos`` sends every row of a key to one
task.  Here the caller names a *chunk*, a column that does not decrease along
the order (``frame_no div 65536``, a time bucket).  Each chunk is scanned on its
own; one summary row per chunk carries the state across chunks; the result is
exact.  A key that holds a third of all rows is spread over its chunks.

Rows are grouped by one struct of key and chunk rather than by several columns:
data that is already hash partitioned by the key alone (after a join, say) would
count as partitioned by (key, chunk) too, and a hot key would stay in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536

_PART, _ORDER, _LOCAL, _CARRY = "_part", "_order", "_local", "_carry"


def position_chunk(pos: Column | str, size: int = CHUNK_ROWS) -> Column:
    """Chunk number of a 0-based position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("long")


def chunk_key(keys: Sequence[str], chunk: Column) -> Column:
    """The key columns and the chunk as one grouping value."""
    return F.struct(*keys, chunk.alias("chunk"))


def _earlier_chunks(keys: Sequence[str]) -> Window:
    return (
        Window.partitionBy(*[F.col(_PART)[k] for k in keys])
        .orderBy(F.col(_PART)["chunk"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row of its key."""
    tagged = df.select(
        "*", chunk_key(keys, chunk).alias(_PART), F.struct(*order).alias(_ORDER), value.alias(_LOCAL)
    )
    tails = tagged.groupBy(_PART).agg(
        F.max(F.when(F.col(_LOCAL).isNotNull(), F.struct(_ORDER, _LOCAL)))[_LOCAL].alias("_tail")
    )
    # Only chunks that inherit a value are joined back: usually very few.
    carried = tails.select(
        _PART, F.last("_tail", ignorenulls=True).over(_earlier_chunks(keys)).alias(_CARRY)
    ).where(F.col(_CARRY).isNotNull())
    within = Window.partitionBy(_PART).orderBy(_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    scanned = tagged.withColumn(_LOCAL, F.last(_LOCAL, ignorenulls=True).over(within))
    return scanned.join(carried, _PART, "left").select(
        *[F.col(c) for c in df.columns], F.coalesce(_LOCAL, _CARRY).alias(out)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` (BIGINT) over the rows of the key up to here."""
    tagged = df.select("*", chunk_key(keys, chunk).alias(_PART), value.cast("long").alias(_LOCAL))
    totals = tagged.groupBy(_PART).agg(F.sum(_LOCAL).alias("_total"))
    bases = totals.select(_PART, F.sum("_total").over(_earlier_chunks(keys)).alias(_CARRY)).where(
        F.col(_CARRY).isNotNull()
    )
    end = 0 if inclusive else -1
    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    scanned = tagged.withColumn("_run", F.coalesce(F.sum(_LOCAL).over(within), F.lit(0)))
    return scanned.join(bases, _PART, "left").select(
        *[F.col(c) for c in df.columns],
        (F.col("_run") + F.coalesce(F.col(_CARRY), F.lit(0))).alias(out),
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """Add ``out``: the 0-based position of each row within its key."""
    return running_sum(df, keys, chunk, order, F.lit(1), out, inclusive=False)
