"""Sharding by a Hilbert curve over metadata (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.common import keep


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the point ``axes`` (integers below ``2 ** bits``).

    Skilling's transform (2004): undo the rotations bit by bit from the top, Gray-code
    the axes, then interleave their bits.  The steps run as one array fold per point.
    """
    n = len(axes)
    element = lambda x, i: F.element_at(x, (i + 1).cast("int"))

    def step(x: Column, s: Column) -> Column:
        i = F.pmod(s, F.lit(n))
        q = F.element_at(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), (F.floor(s / n) + 1).cast("int"))
        p = q - 1
        first, own = element(x, F.lit(0)), element(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        invert = own.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, k: F.when(invert & (k == 0), v.bitwiseXOR(p))
            .when(invert, v)
            .when((k == 0) | (k == i), v.bitwiseXOR(F.when(i == 0, F.lit(0)).otherwise(swap)))
            .otherwise(v),
        )

    start = F.array(*[a.cast("int") for a in axes])
    turned = F.aggregate(F.sequence(F.lit(0), F.lit(n * (bits - 1) - 1)), start, step) if bits > 1 else start
    # Gray code: each axis takes the xor of all up to it.
    gray = F.transform(
        turned,
        lambda v, k: F.aggregate(F.slice(turned, F.lit(1), k + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)),
    )
    last = F.element_at(gray, -1)
    undo = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)] or [F.lit(0)]),
        F.lit(0),
        lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    final = F.transform(gray, lambda v: v.bitwiseXOR(undo))
    parts = [
        F.shiftleft(F.shiftright(F.element_at(final, i + 1), b).bitwiseAND(F.lit(1)).cast("long"), b * n + n - 1 - i)
        for b in range(bits)
        for i in range(n)
    ]
    return reduce(lambda a, b: a + b, parts)


def _depth(cells: DataFrame, name: str, bits: int) -> DataFrame:
    """Level of each value of a category: its place among the rows in value order, in equal steps."""
    order = Window.orderBy(F.col(name).asc_nulls_first())
    counts = cells.groupBy(name).agg(F.sum("_n").alias("_v"))
    before = F.coalesce(F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_v").over(Window.partitionBy())
    return counts.select(name, F.floor(before * (1 << bits) / total).cast("int").alias(f"{name}_level"))


def hilbert_shards(
    docs: DataFrame,
    n_shards: int = 24,
    bits: int = 5,
    bucket_rows: int = 256,
    max_buckets: int = 100_000,
) -> DataFrame:
    """Cut documents into ``n_shards`` runs of a Hilbert curve over (lang, source, length).

    Categories are quantised by their place in value order, the length by half powers of two.
    Runs have equal row counts (law ``rows``: at most one apart), so a shard's files cover
    few languages, sources and lengths and each of these prunes files.

    Place on the curve without a global sort: rows are counted per cell (at most
    ``2 ** (3 * bits)`` points of the curve), a cell is split by a hash of ``doc_id`` into
    buckets of about ``max(bucket_rows, rows / max_buckets)`` rows, the bucket counts are
    summed along the curve, and rows are numbered within their bucket.  A hot source thus
    spreads over many tasks; the table of buckets stays below ``max_buckets`` plus the cells.
    Only ids, sizes and checksums are shuffled; texts never leave the scan.

    Null lang or source: a category of its own, first.  Null or negative length: length 0.
    Null text: size 8, checksum of the empty text.  Repeated rows keep their own slots; ties on
    all columns are interchangeable.  Empty input: no rows.  Other columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null), curve.
    """
    length = F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
    length_level = F.least(F.floor(2 * F.log2(1 + length)), F.lit((1 << bits) - 1)).cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = ["lang", "source", "_len"]
    rows = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        length_level.alias("_len"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    cells = keep(rows.groupBy(*meta).agg(F.count(F.lit(1)).alias("_n")), "cells")
    total = cells.agg(F.sum("_n")).first()[0] or 0
    per_bucket = max(bucket_rows, -(-total // max_buckets))

    def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
        return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])

    for name in ("lang", "source"):
        cells = null_safe(cells, _depth(cells, name, bits), [name])
    axes = [F.col("lang_level"), F.col("source_level"), F.col("_len")]
    placed = cells.select(*meta, "_n", hilbert_index(axes, bits).alias("curve"))
    weight = F.sum("_n").over(Window.partitionBy("curve"))
    placed = keep(placed.select(*meta, "curve", F.ceil(weight / per_bucket).alias("_parts")), "curve")

    def bucketed(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")
        return null_safe(df, placed, meta).withColumn("_part", part)

    along = Window.orderBy("curve", "_part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = bucketed(rows.select("doc_id", *meta)).groupBy("curve", "_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = buckets.select("curve", "_part", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_start"))

    inside = Window.partitionBy("curve", "_part").orderBy("doc_id", "text_crc32", "size")
    place = F.col("_start") + F.row_number().over(inside) - 1
    ranked = bucketed(rows).join(starts, ["curve", "_part"]).withColumn("_at", place.cast("long"))
    n = F.lit(max(total, 1)).cast("long")
    shard = F.expr(f"(_at * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(_s * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("_s", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_s").cast("int").alias("shard"),
        (F.col("_at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def shard_bounds(shards: DataFrame, docs: DataFrame) -> DataFrame:
    """Smallest and largest metadata of each shard, as a reader would use them to skip files."""
    both = shards.select("doc_id", "shard").join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    ends = [f(c).alias(f"{k}_{c}") for c in ("lang", "source", "n_chars") for k, f in (("min", F.min), ("max", F.max))]
    return both.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)
