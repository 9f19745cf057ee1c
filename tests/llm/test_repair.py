"""Conversation repair against plain dynamic programming and its SQL twin."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clipweave.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit) by Bellman steps over (rows used, what was written last), stated on its own."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(reach):
        todo = list(reach)
        while todo:
            last = todo.pop()
            cost, audit = reach[last]
            for r in follow[last]:
                one = (cost + 3, audit + "I")
                if r != "s" and (r not in reach or one < reach[r]):
                    reach[r] = one
                    todo.append(r)
        return reach

    reach = inserted({"": (0, "")})
    for role, fault in rows:
        after = {}

        def put(last, cost, audit):
            if last not in after or (cost, audit) < after[last]:
                after[last] = (cost, audit)

        for last, (cost, audit) in reach.items():
            put(last, cost + 4, audit + "D")
            if fault in (R.BLANK, R.DUPLICATE):
                continue
            more = 3 if fault == R.CUT else 0
            for r in follow[last]:
                if r == role:
                    put(r, cost + more, audit + "K")
                if r != "s":
                    put(r, cost + 3 + more, audit + "R")
        reach = inserted(after)
    return min(reach[x] for x in ("", "a") if x in reach)


def plain(rows):
    """What ``repair(damaged(rows))`` returns, by hand."""
    text = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, body in rows:
        mine = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if kind == 0:
            continue
        body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
        role = "user" if kind == 4 else role
        mine += [(turn is not None, turn or 0, role, body, turn)] * (2 if kind == 3 else 1)
    out = set()
    for conv, mine in convs.items():
        mine.sort()
        seen, faults, illegal = set(), [], 0
        for k, (_, _, role, body, _) in enumerate(mine):
            solid = re.sub(r"[\x20\x09-\x0D]", "", body)
            fault = R.BLANK if not solid else R.DUPLICATE if (role, body) in seen else R.CUT if solid[-1] not in ".!?" else R.OK
            seen.add((role, body))
            faults.append(fault)
            illegal += k > 0 and mine[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = cheapest([(m[2][:1], f) for m, f in zip(mine, faults)])
        i, last, lines = 0, "", []
        for e in audit:
            row = mine[i] if e != "I" else None
            i += e != "I"
            if e == "D":
                continue
            role = row[2] if e == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{row[3] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {m[4] for m in mine if m[4] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in (R.BLANK, R.DUPLICATE, R.CUT)]
        out.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def solved(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_search_finds_the_cheapest_and_least():
    rng = random.Random(11)
    for _ in range(600):
        rows = tuple((rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, R.BLOCK)))
        assert R.search(rows, R.EMPTY, (R.EMPTY, R.DONE))[:2] == cheapest(rows)


@pytest.mark.parametrize("roles", ["u", "a", "s", "x", "ua", "au", "uua", "ssuuaa"])
def test_search_on_hard_orders(roles):
    for fault in (R.OK, R.CUT):
        rows = tuple((r, fault) for r in (roles * R.BLOCK)[: R.BLOCK])
        assert R.search(rows, R.EMPTY, (R.EMPTY, R.DONE))[:2] == cheapest(rows)


def test_long_conversations_are_chained_exactly():
    rng = random.Random(12)
    for _ in range(40):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(20, 160))]
        work = R.Repair()
        for row in rows:
            work.add((*row, row[0], "t"))
        assert work.result()[:2] == cheapest(rows)


def test_query_equals_plain_repair(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    assert solved(R.repair(R.damaged(df))) == plain(rows)


def test_edges(spark):
    rng = random.Random(13)
    bodies = ["Yes.", "No", "", " \t", None, "Why?", "é!", "x" * 200_000 + ".", "a.\n"]
    roles = ["user", "assistant", "system", None, "tool", "", "User"]
    rows = [
        (rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(roles), rng.choice(bodies)) for _ in range(150)
    ]
    rows += [(4, 1, "user", "Same.")] * 30 + [(5, None, "user", "Only.")]
    rows += [(c, 0, "user", "Hi.") for c in range(100, 160)]
    assert any(zlib.crc32(f"{c}:0".encode()) % 20 == 0 for c in range(100, 160))  # one is left without rows
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert solved(R.repair(R.damaged(df))) == want
    extra = df.withColumn("mark", F.lit("x")).withColumn("again", F.lit(1)).withColumn("fault", F.lit("y"))
    assert solved(R.repair(R.damaged(extra))) == want
    assert R.repair(R.damaged(df.limit(0))).count() == 0


def test_one_conversation_with_most_rows_streams_through_one_shuffle(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Row {i}.") for i in range(3000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = R.repair(R.damaged(df))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert solved(found) == plain(rows)
