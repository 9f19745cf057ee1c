import random

from pyspark.sql import functions as F

from clipweave.operators.ordered import dense_index, fill_forward, position_chunk, running_sum
from tests.conftest import rows


def skewed(spark, n=3000, seed=1):
    """Key 0 holds most rows; values are sparse."""
    rng = random.Random(seed)
    data, pos = [], {}
    for _ in range(n):
        k = 0 if rng.random() < 0.7 else rng.randint(1, 40)
        pos[k] = pos.get(k, -1) + rng.randint(1, 3)
        data.append((k, pos[k], rng.randint(0, 99) if rng.random() < 0.05 else None))
    shuffled = data[:]
    rng.shuffle(shuffled)
    return data, spark.createDataFrame(shuffled, "k INT, p INT, v INT").repartition(4, "k")


def test_fill_forward_equals_a_plain_scan(spark):
    data, df = skewed(spark)
    want, last = [], {}
    for k, p, v in data:
        last[k] = v if v is not None else last.get(k)
        want.append((k, p, v, last[k]))
    for size in (1, 7, 64, 100000):
        got = fill_forward(df, ["k"], position_chunk("p", size), [F.col("p")], F.col("v"), "f")
        assert rows(got) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_running_sum_and_index(spark):
    data, df = skewed(spark, seed=2)
    total, count, want = {}, {}, []
    for k, p, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        want.append((k, p, v, total[k], count.get(k, 0)))
        count[k] = count.get(k, 0) + 1
    chunk = position_chunk("p", 50)
    summed = running_sum(df, ["k"], chunk, [F.col("p")], F.coalesce("v", F.lit(0)), "s")
    got = dense_index(summed, ["k"], chunk, [F.col("p")], "n")
    assert rows(got) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_hot_key_is_spread_even_after_a_join_on_it(spark):
    """Data hash partitioned by the key alone must still be shuffled by chunk."""
    _, df = skewed(spark)
    plan = fill_forward(
        df.repartition(4, "k"), ["k"], position_chunk("p", 64), [F.col("p")], F.col("v"), "f"
    )._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan


def test_work_of_a_hot_video_is_spread(spark):
    """Two thirds of the rows have one key; no task may get most of them."""
    rows_ = spark.range(200_000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("p"), F.lit(1).alias("v")
    )
    out = running_sum(rows_, ["k"], position_chunk("p", 1000), [F.col("p")], F.col("v"), "s")
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 100_000
    assert out.agg(F.max("s")).first()[0] == rows_.where("k = 0").count()
