"""Viewer answers to prompts, with a timeout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import strip
from clipweave.operators.ordered import fill_forward

# Seconds to wait for an answer.
APPROVAL_TIMEOUT_S = 15.0
RESOLUTION_TIMEOUT_S = 5.0

CHUNK_S = 600


def first_answer(
    prompts: DataFrame,
    decisions: DataFrame,
    timeout_s: float = APPROVAL_TIMEOUT_S,
    chunk_s: int = CHUNK_S,
) -> DataFrame:
    """Add ``answer`` and ``wait_us``: the first answer within the timeout, else null.

    ``prompts(prompt_id, user_id, ts)``, ``decisions(user_id, ts, answer)``, ``ts``
    TIMESTAMP.  Both are merged on one time line per user that is read backwards,
    each prompt taking the latest seen answer: linear in the rows, where an
    interval join would pair every prompt with every answer near it.  Of answers
    with one time stamp the smallest counts.
    """
    # Times are negated so that "read backwards" is an ascending order.
    back = -F.unix_micros("ts")
    answers = (
        decisions.groupBy("user_id", "ts")
        .agg(F.min("answer").alias("answer"))
        .select(
            F.lit(None).cast(prompts.schema["prompt_id"].dataType).alias("prompt_id"),
            "user_id",
            back.alias("_t"),
            F.lit(0).alias("_side"),
            F.struct(back.alias("t"), "answer").alias("_a"),
        )
    )
    asked = prompts.select(
        "prompt_id",
        "user_id",
        back.alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(answers.schema["_a"].dataType).alias("_a"),
    )
    chunk = F.floor(F.col("_t") / F.lit(chunk_s * 1_000_000))
    merged = fill_forward(
        asked.unionByName(answers),
        ["user_id"],
        chunk,
        [F.col("_t"), F.col("_side")],
        F.col("_a"),
        "_next",
    ).where(F.col("_side") == 1)
    wait = F.col("_t") - F.col("_next.t")
    in_time = wait <= F.lit(int(timeout_s * 1_000_000))
    return merged.select(
        "prompt_id",
        "user_id",
        F.when(in_time, F.col("_next.answer")).alias("answer"),
        F.when(in_time, wait).alias("wait_us"),
    )


def approval(answer: Column, answered: Column) -> Column:
    """``r`` regenerates, ``n`` cancels, anything else or no answer approves."""
    typed = F.lower(strip(answer))
    return (
        F.when(~answered, "approve_timeout")
        .when(typed == "r", "regenerate")
        .when(typed == "n", "cancel")
        .otherwise("approve")
    )


def approve(
    prompts: DataFrame,
    decisions: DataFrame,
    timeout_s: float = APPROVAL_TIMEOUT_S,
    auto_approve: bool = False,
) -> DataFrame:
    """``(prompt_id, user_id, decision)``; with ``auto_approve`` nobody is asked."""
    if auto_approve:
        return prompts.select("prompt_id", "user_id", F.lit("approve").alias("decision"))
    answered = first_answer(prompts, decisions, timeout_s)
    return answered.select(
        "prompt_id", "user_id", approval(F.col("answer"), F.col("wait_us").isNotNull()).alias("decision")
    )


def settle_attempts(attempts: DataFrame) -> DataFrame:
    """``(video_id, attempt, start_s, stop_s, highlight_ok, decision)``: where asking ended.

    ``attempts`` is ``(video_id, attempt, status, start_s, stop_s, decision)``: each
    parsed reply, numbered from 0, with what was decided on it.  Only ``regenerate``
    goes on to the next attempt, so the end is the first attempt that failed to
    parse or was decided otherwise.  A failed first attempt is a failed highlight;
    a failed later one is ``regenerate_failed``.
    """
    failed = F.col("status") != "ok"
    ends = failed | (F.coalesce(F.col("decision"), F.lit("approve_timeout")) != "regenerate")
    last = F.struct("attempt", "start_s", "stop_s", "decision", failed.alias("failed"))
    chain = attempts.where(ends).groupBy("video_id").agg(F.min(last).alias("_e"))
    again = F.col("_e.attempt") > 0
    return chain.select(
        "video_id",
        "_e.attempt",
        "_e.start_s",
        "_e.stop_s",
        (~F.col("_e.failed") | again).alias("highlight_ok"),
        F.when(F.col("_e.failed") & again, "regenerate_failed")
        .when(F.col("_e.decision") == "cancel", "cancel")
        .otherwise("approve")
        .alias("decision"),
    )
