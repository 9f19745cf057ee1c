"""Approval of highlights as answers arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions import compute_once
from clipweave.operators.decisions import APPROVAL_TIMEOUT_S, approval

# Users share a state row per time slot: many small rows cost the state store far more than few larger ones.
BUCKETS = 1024


def _first_at_or_after(answers: Column, user: Column, ts: Column) -> Column:
    """The first entry of the sorted ``answers`` that is not before (user, ts), else null: a binary search."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        entry = F.get(answers, mid)
        before = (entry["user_id"] < user) | ((entry["user_id"] == user) & (entry["ts"] < ts))
        return (
            F.when(acc["lo"] >= acc["hi"], acc)
            .when(before, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
            .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
        )

    whole = F.struct(F.lit(0).alias("lo"), F.size(answers).alias("hi"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(answers) + 1)).cast("int"))
    return F.aggregate(rounds, whole, halve, lambda acc: F.get(answers, acc["lo"]))


def approve_stream(
    prompts: DataFrame,
    decisions: DataFrame,
    timeout_s: float = APPROVAL_TIMEOUT_S,
    lateness: str = "0 seconds",
) -> DataFrame:
    """``(prompt_id, user_id, ts, decision)`` in append mode.

    The streaming form of ``approve``: the first answer of the user within the
    timeout decides, silence approves.  A regenerated highlight is a new prompt row.

    Time is cut into slots as long as the timeout.  A prompt waits with the prompts and
    answers of its slot and the answers of the next, which its timeout can reach, and is
    decided once the watermark has passed both, so up to one timeout after its own wait.
    Up to ``BUCKETS`` rows of state hold a slot, and a busy user is spread over slots.
    Prompts look their answer up in sorted answers, so no prompt is paired with every
    answer near it.  State is dropped as the watermark moves on; ``ts`` of the result is a
    plain column without it.
    """
    slot_us = int(timeout_s * 1_000_000)
    asked = prompts.withWatermark("ts", lateness).select("ts", "user_id", "prompt_id")
    given = decisions.withWatermark("ts", lateness).select("ts", "user_id", "answer", F.lit(True).alias("_given"))
    waits = asked.unionByName(given, allowMissingColumns=True).select(
        "*", F.window("ts", f"{2 * slot_us} microseconds", f"{slot_us} microseconds").alias("_slots")
    )
    is_answer = F.col("_given").isNotNull()
    own_slot = F.unix_micros("ts") < F.unix_micros("_slots.start") + slot_us
    prompt = F.when(~is_answer, F.struct("user_id", "ts", "prompt_id"))
    # Of answers with one time stamp the smallest counts; one without a user is nobody's.
    answer = F.when(
        is_answer & F.col("user_id").isNotNull(), F.struct("user_id", "ts", F.isnull("answer").alias("blank"), "answer")
    )
    slots = (
        waits.where(is_answer | own_slot)
        .groupBy("_slots", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("_bucket"))
        .agg(F.collect_list(prompt).alias("_p"), F.collect_list(answer).alias("_a"))
        .where(F.size("_p") > 0)
    )
    slots = compute_once(slots.select("_p", "_a"), "_asked", F.sort_array("_p"))
    slots = compute_once(slots.select("_asked", "_a"), "_given", F.sort_array("_a"))
    # A prompt that came twice is one.
    once = F.filter("_asked", lambda p, i: (i == 0) | ~p.eqNullSafe(F.get("_asked", i - 1)))
    found = F.transform(
        once, lambda p: F.struct(p.alias("p"), _first_at_or_after(F.col("_given"), p["user_id"], p["ts"]).alias("a"))
    )
    first = slots.select(F.explode(found).alias("_f")).select("_f.p.*", "_f.a")
    waited = F.unix_micros("a.ts") - F.unix_micros("ts")
    answered = F.coalesce((F.col("a.user_id") == F.col("user_id")) & (waited <= slot_us), F.lit(False))
    return first.select("prompt_id", "user_id", "ts", approval(F.col("a.answer"), answered).alias("decision"))
