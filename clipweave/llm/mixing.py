"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The largest mean whose distribution is stored, as at most 127 numbers.
STORED_MEAN = 30.0


def uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) that depends on the seed and the values only (52 bits of an MD5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to a tail below 1e-15 (terms in logs, so large means work)."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.struct((-mean).alias("log_p"), F.array(F.exp(-mean)).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean / k)
        return F.struct(
            log_p.alias("log_p"),
            F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + F.exp(log_p)).alias("cdf"),
        )

    return F.aggregate(F.sequence(F.lit(1), top), first, add)["cdf"]


def poisson_inverse(mean: Column, draw: Column) -> Column:
    """How many of ``poisson_cdf(mean)`` are at most ``draw``, by the same sums without storing them."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")

    def state(log_p: Column, cdf: Column, below: Column) -> Column:
        return F.struct(log_p.alias("log_p"), cdf.alias("cdf"), (below + (cdf <= draw).cast("int")).alias("below"))

    def add(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean / k)
        return state(log_p, acc["cdf"] + F.exp(log_p), acc["below"])

    return F.aggregate(F.sequence(F.lit(1), top), state(-mean, F.exp(-mean), F.lit(0)), add)["below"]


def mixture(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    total: int | None = None,
    key: str = "source",
) -> DataFrame:
    """Per source: rows, target weight, mean repetition and the Poisson distribution of that mean (null above STORED_MEAN).

    ``weights`` names the target share of each source (missing ones get none); without it a
    source's weight is its row count to the power ``power``, which damps a hot source.
    ``total``: wanted rows, by default as many as there are.  Null is a source of its own.
    """
    counts = docs.groupBy(F.col(key).cast("string").alias("_key")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(float(power))))
    else:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        counts = counts.withColumn("weight", F.coalesce(F.element_at(listed, F.coalesce("_key", F.lit(""))), F.lit(0.0)))
    sums = counts.agg(F.sum("weight"), F.sum("n")).first()
    weight_sum, rows = sums[0] or 0.0, sums[1] or 0.0
    share = F.col("weight") / F.lit(weight_sum) if weight_sum > 0 else F.lit(0.0)
    wanted = float(rows if total is None else total)
    mean = counts.select("_key", "n", share.alias("share"), (share * wanted / F.col("n")).alias("mean"))
    large = F.when(F.col("mean") > STORED_MEAN, F.lit(None))
    positive = large.when(F.col("mean") > 0, poisson_cdf(F.greatest("mean", F.lit(1e-300))))
    return mean.withColumn("cdf", positive.otherwise(F.array(F.lit(1.0))))


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    total: int | None = None,
    seed: int = 17,
    key: str = "source",
    id_col: str = "doc_id",
    broadcast_sources: int = 2_000,
) -> DataFrame:
    """Repeat each document as often as a Poisson law of its source's mean says, in random order.

    The count inverts the Poisson distribution at a uniform number drawn from a hash of seed
    and id: no state, and any retry gives the same copies.  Copies are dealt to partitions by a
    second hash and sorted by it there, which is a uniform global shuffle, whatever the source.

    The table of sources is broadcast only if it was counted to hold at most
    ``broadcast_sources`` rows, each with at most 127 numbers and the source's name (about 2 MB);
    else it is joined, and adaptive execution splits a hot source.  Means above ``STORED_MEAN`` store
    nothing and are inverted for each document, in steps that grow like its copies.  Null source: a source of its own.  Repeated ids draw
    alike.  Null id: drawn as one fixed value.  Empty input or weights of zero: no rows.

    Returns the input's columns plus ``copy`` (from 1) and ``shuffle_key``.
    """
    table = mixture(docs, weights, power, total, key).select(
        F.col("_key").alias("_mix_key"), F.col("mean").alias("_mean"), F.col("cdf").alias("_cdf")
    )
    if table.limit(broadcast_sources + 1).count() <= broadcast_sources:
        table = F.broadcast(table)
    joined = docs.join(table, docs[key].cast("string").eqNullSafe(F.col("_mix_key")))
    draw = uniform(seed, id_col)
    stored = F.size(F.filter("_cdf", lambda c: c <= F.col("_draw")))
    copies = F.when(F.col("_cdf").isNotNull(), stored).otherwise(poisson_inverse(F.col("_mean"), F.col("_draw")))
    counted = joined.withColumn("_draw", draw).withColumn("_copies", copies).where("_copies > 0")
    repeated = counted.drop("_cdf", "_draw", "_mean", "_mix_key").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    )
    keyed = repeated.drop("_copies").withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_col)
