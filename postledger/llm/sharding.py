"""Shards of nearly equal bytes by Karmarkar-Karp differencing."""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, type_of, utf8

SHARDS = 40
#: Groups of more than 1/GRAINS of all bytes stand for themselves, all others are gathered by hash
#: into GRAINS grains. So the differencing gets at most 2 * GRAINS numbers, whatever the input.
GRAINS = 8192
ROW_BYTES = 16


def differencing(sizes: list[int], n_shards: int) -> np.ndarray:
    """Shard of each size by the multiway method of Karmarkar and Karp.

    Every size starts as a partial partition with one filled shard. The two
    partial partitions with the largest spread are combined again and again,
    the fullest shard of one with the emptiest of the other, until one is left.
    Ties follow the given order.
    """
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        sums = np.zeros(n_shards, dtype=np.int64)
        sums[0] = size
        parts[i] = (sums, [[i]] + [[] for _ in range(n_shards - 1)])
        heap.append((-int(size) if n_shards > 1 else 0, i))
    heapq.heapify(heap)
    following = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (sums_a, sets_a), (sums_b, sets_b) = parts.pop(a), parts.pop(b)
        sums = sums_a + sums_b[::-1]
        sets = []
        for x, y in zip(sets_a, reversed(sets_b)):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            sets.append(x)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        parts[following] = (sums, [sets[k] for k in order])
        heapq.heappush(heap, (int(sums[-1] - sums[0]), following))
        following += 1
    shard = np.zeros(len(sizes), dtype=np.int32)
    for _, (_, sets) in parts.items():
        for k, members in enumerate(sets):
            shard[members] = k
    return shard


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, grains: int = GRAINS) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) with their shard and slot.

    Rows with equal texts are one indivisible group, null texts count as empty
    ones. Groups are named by a 64-bit hash; should two groups share a hash,
    they stay together, which breaks nothing. The text is read once; all
    further work is on narrow rows, and only two tables of at most ``grains``
    rows each are broadcast. Slots count from 0 in every shard: rows are
    numbered inside (shard, input block), and the totals of earlier blocks are
    added. Repeated rows each get a slot, a null doc_id is an ordinary value,
    other columns are ignored, an empty table gives no rows.
    """
    key = F.xxhash64(utf8())
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(utf8()) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(utf8()).alias("text_crc32"), key.alias("key"),
        F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("row"),
    ))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    grain = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(grains))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    heavy = F.col("bytes") * F.lit(float(grains)) > F.lit(float(total))
    units = groups.groupBy(heavy.alias("heavy"), F.when(heavy, F.col("key")).otherwise(grain).alias("unit")).agg(
        F.sum("bytes").alias("bytes"))

    def place(part):
        part = part.sort_values(["bytes", "heavy", "unit"], ascending=[False, False, True])
        return pd.DataFrame({"heavy": part["heavy"], "unit": part["unit"],
                             "shard": differencing(part["bytes"].tolist(), n_shards)})

    placed = cut_lineage(units.groupBy(F.lit("all").alias("all")).applyInPandas(place, "heavy boolean, unit long, shard int"))
    single = placed.filter("heavy").select(F.col("unit").alias("key"), F.col("shard").alias("own"))
    shared = placed.filter("not heavy").select(F.col("unit").alias("grain"), F.col("shard").alias("common"))
    # both sides have at most `grains` rows by construction
    dealt = (
        rows.withColumn("grain", grain).join(F.broadcast(single), "key", "left").join(F.broadcast(shared), "grain", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"), "block", "row")
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("row")
    return (
        dealt.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "block"])
        .select(
            F.col("doc_id").cast(type_of(docs, "doc_id")), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
