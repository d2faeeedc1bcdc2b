"""Versioned snapshots and the observation log on plain parquet."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version int, run_id string"


class StateStore:
    """Snapshots under ``root/v=N``, made current by a pointer row.

    A snapshot is written in full before its pointer, so a lost job leaves the
    previous version in force, and a run that is already recorded is skipped.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame:
        path = f"{self.root}/pointers"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)
        return self.spark.read.schema(_POINTER).json(path) if exists else self.spark.createDataFrame([], _POINTER)

    def version(self) -> int:
        """Current version; 0 when nothing is stored."""
        return self._pointers().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def version_of(self, run_id: str) -> int:
        """Version that a run wrote; 0 when the run is not stored."""
        return self._pointers().filter(F.col("run_id") == run_id).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def has_run(self, run_id: str) -> bool:
        return self.version_of(run_id) > 0

    def load(self, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A stored snapshot, by default the current one; empty before the first."""
        v = self.version() if version is None else version
        if v == 0:
            if schema is None:
                raise ValueError("an empty store needs a schema")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/v={v}")

    def commit(self, snapshot: DataFrame, run_id: str, version: int) -> int:
        """Write a snapshot, then point at it."""
        snapshot.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        self.spark.createDataFrame([(version, run_id)], _POINTER).coalesce(1).write.mode("append").json(f"{self.root}/pointers")
        return version


_PART_POINTER = "batch long, part int"
#: Parts of a keyed table; a store keeps the number it began with.
PARTS = 64


class KeyedStore:
    """The last row of every key, in parts by the hash of the key, for streams.

    A micro-batch reads and writes only the parts its keys fall into. It writes
    them under ``root/batch=N/part=P`` and then, in one pointer file, names the
    parts it wrote: a lost batch leaves the parts before it in force, and a batch
    that comes again reads what it read the first time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.key, self.parts = spark, root.rstrip("/"), key, parts

    def with_part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))

    def _pointers(self) -> DataFrame:
        path = f"{self.root}/pointers"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)
        return self.spark.read.schema(_PART_POINTER).json(path) if exists else self.spark.createDataFrame([], _PART_POINTER)

    def has_batch(self, number: int) -> bool:
        return not self._pointers().filter(F.col("batch") == number).isEmpty()

    def written(self, number: int) -> list[int]:
        """The parts that a batch wrote."""
        return sorted(r.part for r in self._pointers().filter((F.col("batch") == number) & (F.col("part") >= 0)).collect())

    def load(self, schema: str, touched: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the ``touched`` parts, by default of all, as they were before a batch, by default now."""
        rows = self._pointers().filter("part >= 0")
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        if touched is not None:
            rows = rows.filter(F.col("part").isin(touched))
        # a pointer for each part, of which there are PARTS
        latest = rows.groupBy("part").agg(F.max("batch").alias("batch")).orderBy("part").collect()
        if not latest:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/batch={r.batch}/part={r.part}" for r in latest])

    def commit(self, rows: DataFrame, number: int, touched: list[int]) -> None:
        """Write the next rows of the ``touched`` parts, then point at them. A batch without rows is noted as part -1."""
        if touched:
            self.with_part(rows).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/batch={number}")
        noted = [(number, p) for p in touched] or [(number, -1)]
        self.spark.createDataFrame(noted, _PART_POINTER).coalesce(1).write.mode("append").json(f"{self.root}/pointers")


def append_observations(log: DataFrame, root: str, run_id: str) -> None:
    """Write the log rows of one run. The run's own folder is replaced, so a
    repeated run adds nothing twice."""
    log.drop("run_id").write.mode("overwrite").parquet(f"{root.rstrip('/')}/run_id={run_id}")
