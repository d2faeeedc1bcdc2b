"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

__all__ = ["among", "cut_lineage", "documents", "group_key", "map_rows", "small_batches", "table", "type_of", "utf8", "without"]

# texts are handed to Python in batches of at most so many rows, so that a batch of long texts stays small
ROWS_PER_BATCH = 500
#: Spark's own settings (10,000 rows, 64 MB), and what they are lowered to: several copies of a batch stand in executor and worker at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(ROWS_PER_BATCH)),
           "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{2 << 20}b")}


def small_batches(spark: SparkSession) -> None:
    """Lower the size of the batches that Python workers get, where the session has no setting of its own."""
    for name, (default, small) in BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, small)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def group_key(column: str) -> Column:
    """A join key under which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


#: Slots of the small table that keeps rows from being shuffled for a join that most of them fail.
SLOTS = 1 << 18


def _slots(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")
    # at most SLOTS rows of one number
    return df.withColumn("_slot", slot), F.broadcast(ids.select(slot.alias("_slot")).distinct())


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``ids``; only rows that share a slot with one are shuffled for it."""
    marked, taken = _slots(df, ids, column)
    return marked.join(taken, "_slot", "left_semi").drop("_slot").join(ids.select(column), column, "left_semi").select(*df.columns)


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not in ``ids``, nulls included; only rows that share a slot with one are shuffled for it."""
    marked, taken = _slots(df, ids, column)
    clear = marked.join(taken, "_slot", "left_anti").drop("_slot")
    unsure = marked.join(taken, "_slot", "left_semi").drop("_slot").join(ids.select(column), column, "left_anti")
    return clear.select(*df.columns).unionByName(unsure.select(*df.columns))


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def map_rows(df: DataFrame, fields: list[tuple[str, str | T.DataType]],
             rows_of: Callable[..., Iterator[dict[str, list]]]) -> DataFrame:
    """Apply ``rows_of`` to batches of rows given as one list per column.

    ``rows_of`` is called once per task with an iterator of tuples of lists and
    yields dicts of lists, one per output column.
    """
    schema = T.StructType([T.StructField(n, t if isinstance(t, T.DataType) else T._parse_datatype_string(t)) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                    part = batch.slice(at, ROWS_PER_BATCH)
                    yield tuple(c.to_pylist() for c in part.columns)

        for out in rows_of(slices()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(apply, schema)
