import random

import pytest
from pyspark.sql import functions as F

from postledger.operators import feed
from postledger.operators.ordering import global_positions


def _loop(sizes, budget, cap):
    batches, current, used = [], 0, 0
    out = []
    for s in sizes:
        if current and (used + s > budget or current >= cap):
            batches.append(current)
            current, used = 0, 0
        out.append(len(batches))
        current, used = current + 1, used + s
    return out


def _sized(spark, sizes):
    return spark.createDataFrame([(f"i{k:06d}", s) for k, s in enumerate(sizes)], "internal_id string, bytes int")


@pytest.mark.parametrize("seed,n,cap,chunk,low,high", [
    (1, 700, 9, 25, 50, 900), (2, 400, 7, 400, 50, 900), (3, 1500, 5, 5, 10, 2000), (4, 777, 12, 50, 1, 3), (5, 1, 3, 3, 5, 6),
])
def test_batches_equal_the_sequential_walk(spark, monkeypatch, seed, n, cap, chunk, low, high):
    monkeypatch.setattr(feed, "MAPS_PER_GROUP", 4)
    rnd = random.Random(seed)
    sizes = [rnd.randint(low, high) for _ in range(n)]
    rows = feed.pack_batches(_sized(spark, sizes), [F.col("internal_id")], max_bytes=3500, max_jobs=cap,
                             rows_per_chunk=chunk).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(n))
    assert [r.batch for r in rows] == _loop(sizes, feed.batch_budget(3500), cap)


def test_positions_do_not_depend_on_blocks(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.choice("aab"), i, rnd.randint(1, 9)) for i in range(500)], "k string, i int, w int")
    order = [F.col("k"), F.col("i")]
    one = [tuple(r) for r in global_positions(df, order, F.col("w")).orderBy("pos").collect()]
    many = [tuple(r) for r in global_positions(df, order, F.col("w"), 37).orderBy("pos").collect()]
    assert one == many
