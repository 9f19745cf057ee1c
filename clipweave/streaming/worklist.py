"""Work lists picked up as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipweave.functions import strip
from clipweave.operators.items import pending_items
from clipweave.sources.state import init_state, read_state, write_outcomes


def items_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``(item, list_file)`` from the text files of a folder, comments and blanks dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(
        strip("value").alias("item"), F.col("_metadata.file_path").alias("list_file")
    ).where((F.col("item") != "") & ~F.col("item").startswith("#"))


def start_items(
    items: DataFrame,
    state: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    retry_failures: bool = False,
    once: bool = False,
) -> StreamingQuery:
    """Write the items still to run, one folder per batch.

    ``state`` returns the current ``(item_id, status)`` table and is asked again for
    every batch.  A batch that is run twice overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        todo = pending_items(batch.withColumnRenamed("item", "item_id"), state(), retry_failures)
        todo.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def start_runs(
    items: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    state: str,
    checkpoint: str,
    retry_failures: bool = False,
    once: bool = False,
) -> StreamingQuery:
    """Run the items of each list as it lands and write what came of them back to ``state``.

    ``run`` turns ``(item_id)`` into ``(item_id, outcome)``.  A list is compared with what earlier batches stored, so
    the next one skips what this one did.  A batch that is run twice sees only earlier batches and replaces
    its own rows: each item has one row a batch, and ``read_state`` gives its latest.
    """
    init_state(items.sparkSession, state)

    def work(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select(F.col("item").alias("item_id")).distinct()
        todo = pending_items(asked, read_state(batch.sparkSession, state, before=batch_id), retry_failures)
        write_outcomes(run(todo), state, batch_id)

    writer = items.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
