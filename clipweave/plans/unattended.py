"""Long runs over a work list: batches against stored state until enough items have succeeded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.operators.items import pending_items, take_until
from clipweave.sources.state import init_state, last_batch, read_state, write_outcomes

Runner = Callable[[DataFrame], DataFrame]


def run_until(
    items: DataFrame,
    run: Runner,
    state: str,
    successes: int,
    batch_items: int,
    retry_failures: bool = False,
    max_batches: int | None = None,
) -> DataFrame:
    """Run ``items (line_no, item_id)`` in order, ``batch_items`` at a time, until ``successes`` of them succeeded.

    ``run`` turns a batch of items into ``(item_id, outcome)``.  Each batch is written to ``state`` before the next
    one is chosen, so a run that is stopped (or ends after ``max_batches``) goes on where it was when
    it is called again: what is stored is not run again.  A repeated item runs once.  With
    ``retry_failures`` items that had failed before this call run again, once.

    The driver holds counts only.  Returns ``(line_no, item_id, status, outcome)`` up to and including the
    last wanted success, in the order of the list.
    """
    spark = items.sparkSession
    init_state(spark, state)
    queue = items.groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.min("line_no").alias("line_no"))
    before = last_batch(spark, state) + 1
    done = 0
    while max_batches is None or done < max_batches:
        now = read_state(spark, state)
        if now.where("status = 'success'").join(queue, "item_id", "left_semi").count() >= successes:
            break
        # What failed in this call is closed; what failed earlier may be tried again.
        closed = now.withColumn("status", F.when(F.col("version") >= before, "success").otherwise(F.col("status")))
        todo = pending_items(queue, closed, retry_failures).orderBy("line_no").limit(batch_items)
        batch = last_batch(spark, state) + 1
        write_outcomes(run(todo.select("line_no", "item_id")), state, batch)
        done += 1
        if read_state(spark, state).where(F.col("version") == batch).isEmpty():
            break
    result = read_state(spark, state).join(queue, "item_id").withColumn("_won", F.col("status") == "success")
    return take_until(result, successes, success="_won").select("line_no", "item_id", "status", "outcome")
