"""Connected components of links between numbers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Links contracted at once inside a task; so many at most are finished by one task.
_AT_ONCE = 1 << 18


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number of the links and the smallest one it is connected to, itself left out."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while True:  # follow labels to their own labels
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _contracted(links: DataFrame, roots: bool = False) -> DataFrame:
    """The links of each batch as stars around their smallest number, with ``roots`` that number itself as well."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def apply(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            held.clear()
            u, v = contract(u, v)
            if roots:
                tops = np.unique(v)
                u, v = np.concatenate([u, tops]), np.concatenate([v, tops])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _AT_ONCE:
                yield from flush()
                rows = 0
        if rows:
            yield from flush()

    return links.mapInArrow(apply, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every number that a link (u, v) connects to another; the component is its smallest number.

    Links are first contracted inside tasks. While more than ``_AT_ONCE`` are left, every number, with all its
    neighbours, is tied to the smallest of them; first to larger neighbours,
    then to smaller ones (the two star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014), until a round changes nothing.
    A round has seven shuffles, so what fits one batch of a task is contracted there at once, whatever the size of the input.
    Rounds are written to the shared folder. Nulls and links of a number to itself count for
    nothing; repeated links count once; no links give no rows.
    """
    current = cut_lineage(_contracted(links.select("u", "v").filter("u <> v")))
    before, mark = None, (current.count(),)
    while mark[0] > _AT_ONCE and mark != before:
        before = mark
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smaller = larger.groupBy("u").agg(F.min("v").alias("m"))
        tied = larger.join(smaller, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smaller.withColumnRenamed("m", "v"))
        current = cut_lineage(tied.filter("u <> v").distinct())
        mark = tuple(current.agg(F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))).first()[0])
    if mark[0] <= _AT_ONCE:
        return cut_lineage(_contracted(current.coalesce(1), roots=True)).toDF("node", "component")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
