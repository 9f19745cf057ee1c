"""State of runs: what came of each item, written batch by batch and safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "item_id STRING, status STRING, outcome STRING"
EMPTY_BATCH = -1


def init_state(spark: SparkSession, path: str) -> None:
    """Make an empty state; an existing one is left as it is but for its own empty batch."""
    empty = spark.createDataFrame([], FIELDS)
    empty.write.mode("overwrite").parquet(f"{path}/batch={EMPTY_BATCH}")


def write_outcomes(outcomes: DataFrame, path: str, batch_id: int) -> None:
    """Add the outcomes ``(item_id, outcome)`` of a batch; a batch that is written twice replaces itself.

    ``status`` is what later lists look at: ``success`` or ``failed``.
    """
    status = F.when(F.col("outcome") == "success", "success").otherwise("failed")
    rows = outcomes.select(F.col("item_id").cast("string").alias("item_id"), status.alias("status"), "outcome")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``(item_id, status, outcome, version)``: the latest row of each item, by batch number.

    With ``before`` only earlier batches count, so a batch that is repeated does not see itself.  Only the
    newest row of an item leaves each task; batches outside ``before`` are not read.
    """
    rows = spark.read.schema(f"{FIELDS}, batch LONG").parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    latest = F.max(F.struct("batch", "status", "outcome")).alias("_l")
    return rows.groupBy("item_id").agg(latest).select("item_id", "_l.status", "_l.outcome", F.col("_l.batch").alias("version"))


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the newest batch that has been written, ``EMPTY_BATCH`` if none."""
    found = spark.read.schema(f"{FIELDS}, batch LONG").parquet(path).agg(F.max("batch")).first()[0]
    return EMPTY_BATCH if found is None else found
