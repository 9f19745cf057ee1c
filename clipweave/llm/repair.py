"""Conversation structure repair: the cheapest edits by depth-first branch and bound."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; an undeleted truncated row costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What has been written so far: nothing, a system row, a user row (one waits for its answer), a full exchange.
EMPTY, SYSTEM, USER, DONE = range(4)
#: Written role by state, and the state it leads to.
_NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}
_ENDS = (EMPTY, DONE)
_NAMES = {"u": "user", "a": "assistant"}
#: Rows that are searched at once; longer conversations are chained from such blocks.
BLOCK = 24
OK, BLANK, DUPLICATE, CUT = range(4)
_FULL_STOP = "[.!?]"
_SPACES = r"\x20\x09-\x0D"


def _branches(row: tuple[str, int] | None, state: int) -> list[tuple[int, str, int, int]]:
    """Edits open at a node: (cost, initial, next state, rows used), the cheapest first, ties by initial.

    Only roles that keep the conversation well formed are offered.  The written text of a
    rerole or insert is known from the state, so (initials, state) determine the repair.
    """
    out = [(INSERT, "I", to, 0) for role, to in _NEXT[state].items() if role in _NAMES]
    if row is not None:
        role, fault = row
        out.append((DELETE, "D", state, 1))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if role in _NEXT[state]:
                out.append((more, "K", _NEXT[state][role], 1))
            out += [(REROLE + more, "R", to, 1) for r, to in _NEXT[state].items() if r in _NAMES]
    return sorted(out)


def _least_ahead(rows: tuple) -> list[int]:
    """For each row, what it and the rows after it cost at least, whatever the state.

    A blank or duplicate row is deleted.  Another is kept if its role can be written at all; then a
    truncated one costs its surcharge.  Two kept rows with the same role in a row need an edit
    between them, so one of each disjoint pair of such neighbours adds the cheapest edit.
    """
    own, pair = [], []
    for j, (role, fault) in enumerate(rows):
        more = TRUNCATED if fault == CUT else 0
        own.append(DELETE if fault in (BLANK, DUPLICATE) else min(DELETE, more + (0 if role in "sua" and role else REROLE)))
        before = rows[j - 1] if j else None
        clean = before is not None and before[1] == OK and fault == OK and role == before[0] and role in ("s", "u", "a")
        pair.append(clean)
    ahead = [0] * (len(rows) + 2)
    cheapest = min(REROLE, DELETE, INSERT)
    for j in range(len(rows) - 1, -1, -1):
        ahead[j] = own[j] + ahead[j + 1]
        if j + 1 < len(rows) and pair[j + 1]:
            ahead[j] = max(ahead[j], cheapest + ahead[j + 2])
    return ahead


@functools.lru_cache(maxsize=1 << 13)
def search(rows: tuple, state: int, ends: tuple) -> tuple[int, str, int] | None:
    """Cheapest (cost, initials, last state) from ``state`` over all of ``rows`` to one of ``ends``.

    Depth first with an explicit stack.  A node is (rows used, state).  A prefix is dropped if its cost
    and the least that the rows ahead cost exceed the incumbent, or if a prefix as good has
    reached the node before: equal suffixes are open to both, and of prefixes with equal cost to
    one node neither begins the other (inserts cost), so the smaller initials stay smaller.
    The stack is empty when nothing can beat the incumbent: it is optimal.
    """
    ahead = _least_ahead(rows)
    n = len(rows)
    best: tuple[int, str, int] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, state)]
    while stack:
        cost, audit, i, at = stack.pop()
        if best is not None and cost + ahead[i] > best[0]:
            continue
        known = table.get((i, at))
        if known is not None and known < (cost, audit):
            continue
        if i == n and at in ends and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, at)
        for more, initial, to, used in reversed(_branches(rows[i] if i < n else None, at)):
            found, node = (cost + more, audit + initial), (i + used, to)
            if best is not None and found[0] + ahead[node[0]] > best[0]:
                continue
            if node not in table or found < table[node]:
                table[node] = found
                stack.append((*found, *node))
    return best


def _write(rows: list[tuple], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of ``rows (initial, fault, role, text)`` under the edits of ``audit``."""
    i = 0
    for initial in audit:
        if initial == "D":
            i += 1
            continue
        if initial == "K":
            role, text = rows[i][2], rows[i][3]
            state = _NEXT[state][rows[i][0]]
        else:
            letter = "a" if state == USER else "u"
            role, text = _NAMES[letter], "" if initial == "I" else rows[i][3]
            state = _NEXT[state][letter]
        i += initial != "I"
        yield role, text


class Repair:
    """Repair of one conversation whose rows arrive in order; holds one block of rows and at most four prefixes."""

    def __init__(self) -> None:
        self.block: list[tuple] = []
        #: Initials on which all prefixes agree, in pieces.
        self.common: list[str] = []
        #: Best prefix by state: cost, its initials after the common ones, hash of what it writes, whether it wrote.
        self.prefixes: dict[int, tuple] = {EMPTY: (0, "", hashlib.sha256(), False)}

    def add(self, row: tuple) -> None:
        """Take the next row (initial, fault, role, text)."""
        if len(self.block) == BLOCK:
            self._close([(e,) for e in (EMPTY, SYSTEM, USER, DONE)])
        self.block.append(row)

    def _close(self, wanted: list[tuple]) -> None:
        """Extend the prefixes over the block: for each tuple of last states, the best one."""
        key = tuple(row[:2] for row in self.block)
        after = {}
        for ends in wanted:
            best = None
            for state, (cost, tail, _, _) in self.prefixes.items():
                found = search(key, state, ends)
                if found is not None:
                    one = (cost + found[0], tail + found[1], found[2], state, found[1])
                    best = one if best is None else min(best, one)
            if best is None:
                continue
            cost, tail, last, state, audit = best
            _, _, sha, wrote = self.prefixes[state]
            sha = sha.copy()
            for role, text in _write(self.block, audit, state):
                sha.update(f"\n{role}:{text}".encode() if wrote else f"{role}:{text}".encode())
                wrote = True
            after[last] = (cost, tail, sha, wrote)
        shared = os.path.commonprefix([p[1] for p in after.values()])
        self.common.append(shared)
        self.prefixes = {s: (c, tail[len(shared) :], sha, wrote) for s, (c, tail, sha, wrote) in after.items()}
        self.block = []

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, sha256 of the repaired rows)."""
        self._close([_ENDS])
        ((cost, tail, sha, _),) = self.prefixes.values()
        return cost, "".join(self.common) + tail, sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The table after known damage, by crc32 of ``conv_id:turn`` modulo 20; ``present`` is false for a dropped row.

    0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        blank("role").alias("role"),
        blank("text").alias("text"),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", _FULL_STOP, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(times).alias("_time")
    ).drop("_time")


def _fault() -> Column:
    """The first fault of a row: blank, then ``again`` (its role and text were seen earlier), then truncated."""
    ending = F.regexp_extract("text", f"([^{_SPACES}])[{_SPACES}]*\\z", 1)
    return (
        F.when(ending == "", BLANK).when(F.col("again"), DUPLICATE).when(~ending.rlike(_FULL_STOP), CUT).otherwise(OK)
    ).cast("int")


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``(conv_id, turn, role, text[, present])``.

    Rows are taken by turn (nulls first; ties by role and text).  A repaired conversation has role
    initials ``(s?(ua)+)?``.  Keep costs 0, Rerole to user or assistant 3, Delete 4 (a must for blank and
    duplicate rows), Insert of an empty user or assistant row 3; an undeleted truncated row costs 3
    more.  Of the cheapest lists of edits the one with the least initials (ASCII) is taken.

    Spark deals and sorts the rows by conversation; each task reads its rows in order and holds one
    block of 24 with at most four prefixes (one per state), searched by branch and bound, so a
    conversation of any length fits.  The hash of its repaired rows is one running hash, which is
    why one task reads it.  What repeats is marked by a window inside the same shuffle.

    Null role or text: one space (a blank row, or a role that cannot stay).  An empty role has no
    initial and cannot stay either.  A null conv_id is a conversation of its own.  A row that is not
    ``present`` only names its conversation; without that column all are.  Repeated rows are
    duplicates.  No rows: no conversation; extra columns are ignored.

    Returns conv_id, gaps (missing turns between the first and last), blank, duplicate, truncated, illegal
    (neighbours in an order other than su, ua, au), cost, audit, repaired_sha256.
    """
    here = F.coalesce("present", F.lit(True)) if "present" in conversations.columns else F.lit(True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), here.alias("present"),
    )
    rows = rows.withColumn("mark", F.when(F.col("present"), F.xxhash64("role", "text")))
    # One shuffle by conversation serves the window and the search; equal hashes are compared as texts.
    seen = Window.partitionBy("conv_id", "mark", "role", "text").orderBy("turn")
    rows = rows.repartition("conv_id").withColumn("again", F.col("present") & (F.row_number().over(seen) > 1))
    rows = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), _fault().alias("fault"), "role", "text", "present")
    ordered = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault")
    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string"
    )
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [f.split()[0] for f in schema.split(", ")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = {"su", "ua", "au"}
        out: list[tuple] = []
        key: object = solve  # no conversation yet
        work = first = last = before = None
        turns = illegal = 0
        counts = [0, 0, 0, 0]

        def result() -> tuple:
            gaps = last - first + 1 - turns if turns else 0
            return (key, gaps, *counts[1:], illegal, *work.result())

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, turn, initial, fault, role, body, present in zip(*columns):
                if conv != key or work is None:
                    if work is not None:
                        out.append(result())
                    key, work, first, last, before = conv, Repair(), None, None, None
                    turns, illegal, counts = 0, 0, [0, 0, 0, 0]
                if not present:
                    continue
                if turn is not None and turn != last:
                    first = turn if first is None else first
                    last, turns = turn, turns + 1
                if before is not None and before + initial not in legal:
                    illegal += 1
                before = initial
                counts[fault] += 1
                work.add((initial, fault, role, body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if work is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(result(), types)], names)

    return ordered.select("conv_id", "turn", "initial", "fault", "role", "text", "present").mapInArrow(solve, schema)
