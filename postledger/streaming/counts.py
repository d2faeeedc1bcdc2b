"""Counts of observations per time window."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import cut_lineage
from ..sinks.state import StateStore

#: Open windows, and in a row without status the latest time seen so far as ``window_end``.
OPEN_WINDOWS = "window_start timestamp, window_end timestamp, status string, observations long"


def stream_status_counts(log: DataFrame, window: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Observations per window and status; a window is final once the watermark
    has passed it, and later rows for it are left out."""
    return (
        log.withWatermark("observed_at", delay)
        .groupBy(F.window("observed_at", window), "status")
        .agg(F.count("*").alias("observations"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "status", "observations")
    )


def count_batch(batch: DataFrame, state: DataFrame, window: str, delay: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(late, closed, open)`` after a batch.

    The watermark of a batch is the latest time of all batches before it, less ``delay``.
    Rows whose window the watermark has passed, and rows without a time, are
    late: they are put aside and change no count. The batch then moves the
    watermark, and windows that it passes are closed.
    """
    back = F.expr(f"INTERVAL {delay}")
    held = state.filter("status is null").agg(F.max("window_end").alias("high"))
    rows = batch.select("observed_at", F.coalesce("status", F.lit("")).alias("status"), F.window("observed_at", window).alias("w")).select(
        "observed_at", "status", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))
    # F.window leaves rows without a time out
    timeless = batch.filter("observed_at is null").select(
        "observed_at", F.coalesce("status", F.lit("")).alias("status"), *[F.lit(None).cast("timestamp").alias(c) for c in ("window_start", "window_end")])
    passed = held.select((F.col("high") - back).alias("m")).scalar()
    behind = F.coalesce(F.col("window_end") <= passed, F.lit(False))
    late = rows.filter(behind).unionByName(timeless)
    counted = rows.filter(~behind).groupBy("window_start", "window_end", "status").agg(F.count("*").alias("observations"))
    kept = state.filter("status is not null").unionByName(counted).groupBy("window_start", "window_end", "status").agg(F.sum("observations").alias("observations"))
    high = held.unionByName(batch.agg(F.max("observed_at").alias("high"))).agg(F.max("high").alias("high"))
    over = F.coalesce(F.col("window_end") <= high.select((F.col("high") - back).alias("m")).scalar(), F.lit(False))
    mark = high.select(F.lit(None).cast("timestamp").alias("window_start"), F.col("high").alias("window_end"),
                       F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("observations"))
    return late, kept.filter(over), kept.filter(~over).unionByName(mark)


def stream_counts_and_late_rows(log: DataFrame, store: StateStore, out: str, checkpoint: str, window: str = "1 day",
                                delay: str = "2 hours") -> StreamingQuery:
    """Counts of closed windows under ``out/windows``, late rows under ``out/late``, each in a folder per batch.

    Open windows stay in ``store``. Closed windows, open windows and late rows
    together are all rows of ``log`` (observed_at, status); a null status counts
    as an empty one. A batch that comes again after a failure writes the same folders.
    """
    def fold(batch: DataFrame, number: int) -> None:
        done = store.version_of(f"batch-{number}")
        before = done - 1 if done else store.version()
        state = store.load(OPEN_WINDOWS, before)
        late, closed, still_open = count_batch(cut_lineage(batch.select("observed_at", "status")), state, window, delay)
        late.write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        closed.write.mode("overwrite").parquet(f"{out}/windows/batch={number}")
        if not done:
            store.commit(still_open, f"batch-{number}", before + 1)

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
