"""Token counts of sections: whole documents are encoded once, tokens are joined to spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.tokens import byte_sizes, encode

RULES = ("first", "last", "share")


def token_spans(text: str, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of ``text``.

    A byte-level vocabulary covers the bytes without gaps, so ends are running sums of token
    sizes.  A token that holds part of a character counts as covering that character.
    """
    ends = np.cumsum(byte_sizes(folder)[encode(text, folder)])
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return char[starts], char[ends - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as character spans; a line break belongs to the line it ends."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return np.array(cuts[:-1], np.int64), np.array(cuts[1:], np.int64)


def join_spans(first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [lo, hi) by ``rule``, and how many of its tokens cross its borders.

    Token spans ascend, so every section is two binary searches; sections may overlap or leave gaps.
    """
    touch_lo = np.searchsorted(end, lo, "right")
    touch_hi = np.searchsorted(first, hi, "left")
    touched = np.maximum(touch_hi - touch_lo, 0) * (hi > lo)
    inside = np.maximum(np.searchsorted(end, hi, "right") - np.searchsorted(first, lo, "left"), 0) * (hi > lo)
    crossing = touched - np.minimum(inside, touched)
    if rule == "first":
        counts = np.searchsorted(first, hi, "left") - np.searchsorted(first, lo, "left")
    elif rule == "last":
        counts = np.searchsorted(end, hi, "right") - np.searchsorted(end, lo, "right")
    else:
        counts = np.minimum(inside, touched).astype(float)
        for i in np.flatnonzero(crossing):
            t = np.arange(touch_lo[i], touch_hi[i])
            part = (np.minimum(end[t], hi[i]) - np.maximum(first[t], lo[i])) / (end[t] - first[t])
            counts[i] = part.sum()
    return np.where(hi > lo, counts, 0).astype(float), crossing


def section_tokens(
    docs: DataFrame, sections: str | None = None, rule: str = "first", folder: str | None = None
) -> DataFrame:
    """Tokens of each section of each document, from one encoding of the whole document.

    ``sections`` names a column of character spans (array of struct start, end); by default the
    lines of the text.  Encoding a section alone would change the tokens at its borders; here a
    token that crosses a border is allocated by ``rule``: to the section of its ``first``
    character (default), of its ``last`` one, or in ``share`` by characters.  So the sections
    of a partition of the text add up to the document's count.

    All in one map pass: nothing is shuffled and a task holds one batch of documents.  Null or empty
    text: one row with section null and no tokens.  Spans are cut to the text; null or reversed
    ones are empty.  Repeated rows repeat their result.  Empty input: no rows.

    Returns doc_id, section (from 0), start, end, tokens, crossing, doc_tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            rows = 0
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if not text:
                    row = [np.array([x], object) for x in (doc, None, 0, 0, 0.0, 0, 0)]
                else:
                    first, end = token_spans(text, folder)
                    if sections is None:
                        lo, hi = lines(text)
                    else:
                        spans = [(s["start"], s["end"]) if s else (0, 0) for s in batch.column(2)[i].as_py() or []]
                        spans = [(a or 0, b or 0) for a, b in spans]
                        lo, hi = np.clip(np.array(spans, np.int64).reshape(-1, 2), 0, len(text)).T
                        hi = np.maximum(lo, hi)
                    counts, crossing = join_spans(first, end, lo, hi, rule)
                    n = len(lo)
                    row = [np.full(n, doc), np.arange(n), lo, hi, counts, crossing, np.full(n, len(first))]
                rows += len(row[0])
                for column, x in zip(out, row):
                    column.append(x)
                if rows >= 50_000 or i == batch.num_rows - 1:
                    columns = [np.concatenate([np.asarray(x, object) for x in c]) if any(x.dtype == object for x in c) else np.concatenate(c) for c in out]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                    out, rows = [[] for _ in names], 0

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if sections is not None:
        columns.append(F.transform(sections, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("_spans"))
    schema = "doc_id long, section int, start long, end long, tokens double, crossing long, doc_tokens long"
    return docs.select(*columns).mapInArrow(count, schema)
