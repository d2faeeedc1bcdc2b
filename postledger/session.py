"""Session settings and the shared folder used to cut lineage."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime settings that every operator relies on; all can be changed per session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # window groups of at most this many leading rows are trimmed before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
    # no call-site capture per column expression; it slows plan building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "postledger", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    A cluster sets that to shared storage. A temporary folder stands in for it
    only where driver and executors are one process; anywhere else each executor
    would write to a disk of its own, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="postledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files survive lost executors, and later stages start from a plain
    parquet scan, so column pruning and statistics still work. ``codec``
    compresses them otherwise than the session does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, codec: str | None = None, /, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`cut_lineage`, with aggregates of the rows taken on the way, during the one write.

    The aggregates belong to the tasks that write, each of which counts once
    however often it is tried; so nothing may be shuffled behind them.
    """
    seen = Observation()
    out = cut_lineage(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), codec)
    return out, {n: seen.get.get(n) or 0 for n in counts}


def remove_shared(spark: SparkSession) -> None:
    """Delete this application's folder, once no DataFrame that reads from it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
