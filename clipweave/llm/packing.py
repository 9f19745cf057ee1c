"""Hierarchical residual packing of token sequences: local best fit, then a tree merge of underfull bins."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import keep, runs
from clipweave.llm.tokens import encode

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, separator: int, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokens of each document, then ``separator``; longer ones are cut, the first piece takes the remainder."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + [("ids", pa.binary())] * with_ids
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py(), folder), separator).astype("<u4")
                start, piece = 0, 0
                size = len(ids) % capacity or min(capacity, len(ids))
                while start < len(ids):
                    data = ids[start : start + size].tobytes()
                    row = (doc, piece, start, size, crc32(data)) + ((data,) if with_ids else ())
                    for column, x in zip(out, row):
                        column.append(x)
                    start, piece, size = start + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return wanted.mapInArrow(cut, _PIECE + ", ids binary" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions): each item, in the given order, goes to the fullest bin it fits.

    Bins are stacked by free room; one integer has a bit for each room that some bin has, so the
    smallest sufficient room is found by a shift.
    """
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i, size in enumerate(sizes):
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = room[free]
            b = stack.pop()
            if not stack:
                some &= ~(1 << free)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - size
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins


def _pack_level(items: DataFrame, groups: int, level: int, capacity: int, slack: int) -> DataFrame:
    """One round of best fit in each group: rows are bins with their members in order.

    Items are dealt by the number of their row in the written table, so copies of a document, and
    documents without an id, spread over all groups.
    """
    member = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    schema = pa.schema([("fill", pa.int64()), ("full", pa.bool_()), ("members", pa.list_(member))])
    dealt = items.withColumn("spot", F.xxhash64(F.lit(level), "number"))
    dealt = dealt.withColumn("grp", F.pmod(F.col("spot"), F.lit(groups)).cast("int"))
    rows = dealt.repartition("grp").sortWithinPartitions("grp", F.col("fill").desc(), "spot").select("grp", "fill", "members")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["grp"]):
            fill = t.column("fill").to_numpy()
            lists = t.column("members").combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.chunk(0)
            edges = lists.offsets.to_numpy()
            bins = best_fit(fill.tolist(), capacity)
            at = [np.arange(edges[i], edges[i + 1]) for b in bins for i in b]
            counts = [sum(int(edges[i + 1] - edges[i]) for i in b) for b in bins]
            values = lists.values.take(pa.array(np.concatenate(at))).cast(member)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            total = np.array([int(fill[b].sum()) for b in bins])
            yield pa.RecordBatch.from_arrays(
                [pa.array(total), pa.array(total >= capacity - slack), pa.ListArray.from_arrays(offsets, values)],
                schema=schema,
            )

    return rows.mapInArrow(pack, f"fill long, full boolean, members array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>")


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    separator: int = 0,
    slack: int = 8,
    group_items: int = 4096,
    max_levels: int = 12,
    folder: str | None = None,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document's tokens end with ``separator``.  Only longer documents are cut; all their pieces
    but the first are full sequences by themselves.  The rest are packed in a tree: items are
    dealt by hash to groups of about ``group_items``, each group packs best-fit by falling size,
    bins with at most ``slack`` free tokens are emitted, and underfull bins go to the next
    level as items, in fewer groups.  It ends with one group, when a level saves less than one bin in a
    hundred, or after ``max_levels`` levels (bins stay as they are then), so no task ever holds more
    than a group.  Groups are dealt by row, so one repeated or missing id does not fill a group.

    Tokens are made once and written to the shared folder; only numbers move after that.

    Null or empty text: the separator alone.  A null id is kept.  Repeated rows are packed each for itself.  Empty
    input: no rows.  Other columns are ignored.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    row = F.monotonically_increasing_id()
    cut = keep(pieces(docs, capacity, separator, folder).withColumn("number", row), "pieces")
    alone = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("number"))
    item = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32"))
    items = cut.where(F.col("length") < capacity).select("number", F.col("length").alias("fill"), item.alias("members"))
    n, done = items.count(), []
    for level in range(max_levels):
        if n == 0:
            break
        groups = -(-n // group_items)
        packed = _pack_level(items, groups, level, capacity, slack)
        # Row numbers of the written table, with the level above their bits: no two bins share one.
        bins = keep(packed.withColumn("sequence_id", F.lit(level << 58) + row), f"level{level}")
        counts = bins.groupBy("full").count().collect()
        underfull = sum(r["count"] for r in counts if not r["full"])
        last = groups == 1 or underfull > 0.99 * n or level == max_levels - 1
        done.append(bins if last else bins.where("full"))
        if last:
            break
        items, n = bins.where("NOT full").select(F.col("sequence_id").alias("number"), "fill", "members"), underfull
    out = alone.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.lit(0).cast("long").alias("offset"))
    for bins in done:
        before = F.aggregate(F.slice("members", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
        flat = bins.select("sequence_id", "members", F.posexplode("members").alias("_i", "_m"))
        out = out.union(flat.select("_m.doc_id", "_m.piece", "_m.start", "_m.length", "_m.ids_crc32", "sequence_id", before.alias("offset")))
    return out
