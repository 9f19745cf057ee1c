"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from clipweave.session import ensure_checkpoint_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and
    gives later joins the real size.  ``clear_scratch`` deletes all such tables.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what ``keep`` has written in this application; call it after the results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys from sorted Arrow batches, as (key, table).

    One group is held at a time, so groups must be bounded; the sort keeps a group in one task.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        n, rest = table.num_rows, None
        if n == 0:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            col = table.column(k).to_numpy()
            change[1:] |= col[1:] != col[:-1]
        starts = np.append(np.flatnonzero(change), n)
        at = 0
        for end in starts[:-1]:
            yield tuple(table.column(k)[at].as_py() for k in keys), table.slice(at, end - at)
            at = int(end)
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield tuple(rest.column(k)[0].as_py() for k in keys), rest


def text_slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``limit`` UTF-8 bytes; a null text is empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
