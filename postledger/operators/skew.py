"""Building blocks that stay even when one key holds a large share of all rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str, spread: Column,
                salts: int = SALTS) -> DataFrame:
    """Equi join whose keys may be hot on the ``big`` side; ``small`` holds one row
    per source or the like, so that repeating it is cheap.

    Rows of ``big`` spread over ``salts`` sub-keys by the hash of ``spread``;
    every row of ``small`` is repeated once per sub-key. Spark still broadcasts
    ``small`` by itself when its measured size allows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    spread: Column, salts: int | None = None) -> DataFrame:
    """First ``n`` rows of each group in ``order``; exact for hot groups.

    The winners of a group are among the winners of its salted parts, so the
    last window sees at most ``n * salts`` rows per group. By default a group
    spreads over as many parts as there are shuffle partitions, up to 1024.
    """
    if salts is None:
        salts = max(SALTS, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
