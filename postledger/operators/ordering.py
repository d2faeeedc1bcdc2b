"""Positions and running totals in one global order, without one big task."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_BLOCK = 20_000


def global_positions(df: DataFrame, order: list[Column], weight: Column, rows_per_block: int = ROWS_PER_BLOCK,
                     rows: int | None = None) -> DataFrame:
    """Add ``pos`` (from 0) and ``cum`` (running sum of ``weight``, inclusive).

    Rows are range-partitioned by ``order`` (which must be unique), written so
    that the partition of each row is settled, and numbered within partitions.
    Only one total per partition is summed in a single task. ``rows`` saves the
    count when the caller knows it.
    """
    n = df.count() if rows is None else rows
    blocks = max(1, math.ceil(n / rows_per_block))
    weighted = df.withColumn("_w", weight.cast("long"))
    placed = cut_lineage(
        weighted.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))
    totals = placed.groupBy("_block").agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = totals.select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    within = Window.partitionBy("_block").orderBy(*order)
    # one small row per block; Spark broadcasts them where their size allows
    return placed.join(offsets, "_block").select(
        *df.columns,
        (F.row_number().over(within) - 1 + F.col("_n0")).cast("long").alias("pos"),
        (F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s0")).alias("cum"),
    )
