"""Streaming queries: the given tables arrive as a stream and the results are
written as parquet to the shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import watch as W
from ..session import shared_folder
from ..sinks.state import KeyedStore, StateStore
from ..streaming.counts import OPEN_WINDOWS, stream_counts_and_late_rows, stream_status_counts
from ..streaming.keyed import stream_status, stream_watch_diff
from ..streaming.runs import stream_runs
from .pages import CHECK_SQL, changed_pages
from .registry import query
from .views import SQL_DIFF, STATUS_OF_EVENT, all_postings, current_postings


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf: str, name: str) -> DataFrame:
    # the pattern works for a table that is one file as well as for a folder
    reader = spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).option("maxFilesPerTrigger", 256)
    return reader.parquet(f"{sf}/{name}.parque[t]")


def _run(out: DataFrame) -> DataFrame:
    """Process all that is there, then read the result back."""
    spark, folder = out.sparkSession, _folder(out.sparkSession, "stream")
    writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _fold(stream, arrivals: DataFrame, key: str) -> DataFrame:
    """Run a stream of batch folds over all that is there, then read the result back."""
    spark, folder = arrivals.sparkSession, _folder(arrivals.sparkSession, "fold")
    stream(arrivals, KeyedStore(spark, f"{folder}/state", key), f"{folder}/out", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_status_counts", f"""WITH e AS (SELECT date_trunc('day', ts) AS d, {STATUS_OF_EVENT} AS status FROM events)
  SELECT strftime(d, '%Y-%m-%d') AS day, status, count(*) AS observations FROM e
  WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def status_counts(spark, sf):
    log = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("observed_at"), F.expr(STATUS_OF_EVENT).alias("status"))
    out = _run(stream_status_counts(log))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "observations")


_ARRIVALS, _DAYS = 4, 8
_GROUP = "least(cast(floor((dayofmonth(ts) - 1) / {d}) as int) + case when event_id % 10 = 3 then 1 else 0 end, {n})".format(d=_DAYS, n=_ARRIVALS - 1)


@query("stream_late_rows", f"""WITH e AS (SELECT ts, {STATUS_OF_EVENT} AS status, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
    least(CAST(floor((day(ts) - 1) / {_DAYS}) AS INT) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, {_ARRIVALS - 1}) AS g FROM events),
  b AS (SELECT g, max(max(ts)) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM e GROUP BY g),
  k AS (SELECT status, window_end, CASE WHEN window_end <= mark THEN 'late' WHEN window_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR THEN 'closed'
    ELSE 'open' END AS kind FROM e JOIN b USING (g))
  SELECT kind, strftime(window_end - INTERVAL 1 DAY, '%Y-%m-%d') AS day, status, count(*) AS observations FROM k GROUP BY ALL""")
def late_rows(spark, sf):
    """All events in a few batches, a tenth of them a batch late: rows of closed windows are kept aside and counted."""
    root = _folder(spark, "late")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("g", F.expr(_GROUP))
    store = StateStore(spark, f"{root}/state")
    schema = "observed_at timestamp, status string"
    for g in range(_ARRIVALS):  # one batch after the other, as a stream over all of them keeps no order
        events.filter(F.col("g") == g).select(F.col("ts").cast("timestamp").alias("observed_at"), F.expr(STATUS_OF_EVENT).alias("status")).write.parquet(f"{root}/in/g={g}")
        log = spark.readStream.schema(schema).parquet(f"{root}/in/g=*")
        stream_counts_and_late_rows(log, store, f"{root}/out", f"{root}/log").awaitTermination()
    late = spark.read.parquet(f"{root}/out/late").groupBy("window_start", "window_end", "status").agg(F.count("*").alias("observations"))
    closed = spark.read.parquet(f"{root}/out/windows").drop("batch")
    kinds = (("late", late), ("closed", closed), ("open", store.load(OPEN_WINDOWS).filter("status is not null")))
    parts = [df.select(F.lit(kind).alias("kind"), F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "observations") for kind, df in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_status", """WITH e AS (SELECT user_id, event_id, event_type, event_type = 'error' AS closed,
    lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT CAST(user_id AS VARCHAR) AS internal_id, event_id AS seq, CASE WHEN closed THEN 'expired' WHEN before IS NULL THEN 'new' WHEN before = 'error' THEN 'reopened'
    WHEN before = event_type THEN 'unchanged' ELSE 'changed' END AS status FROM e""")
def status(spark, sf):
    arrivals = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("internal_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("content_hash"), (F.col("event_type") == "error").alias("closed"))
    return _fold(stream_status, arrivals, "internal_id").select("internal_id", "seq", "status")


@query("stream_watch_diff", CHECK_SQL.replace("replace(html, 'ou', 'o')", "html") + """ SELECT id, CASE WHEN k IN (1, 2) THEN 'error' WHEN k >= 5 THEN 'changed' ELSE 'unchanged' END AS status,
    CASE WHEN k >= 5 THEN added ELSE '' END AS added_text, CASE WHEN k >= 5 THEN 'apply now, MONDAY' ELSE '' END AS keywords_found FROM o""")
def watch(spark, sf):
    """Every page arrives twice: as it was, then with the changes of the check."""
    p = _stream(spark, sf, "pages")
    ident = F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id")
    first = p.select(ident, F.lit("").alias("name"), "url", F.col("url").alias("final_url"), F.lit(200).alias("http_status"),
                     F.lit(None).cast("string").alias("error"), "html", F.lit("2024-01-01 06:00:00").cast("timestamp_ntz").alias("checked_at"))
    second = changed_pages(p)
    checks = W.page_texts(first.unionByName(second)).select(
        "id", F.unix_seconds(F.col("checked_at").cast("timestamp")).alias("seq"), F.col("checked_at").cast("timestamp").alias("checked_at"), "content_text",
        "content_hash", "check_error", F.array(F.lit("apply now"), F.lit("Deadline"), F.lit("MONDAY")).alias("keywords"))
    out = _fold(stream_watch_diff, checks, "id")
    return out.filter("checked_at > timestamp'2024-01-02'").select("id", "status", "added_text", "keywords_found")


@query("stream_runs", SQL_DIFF.replace("doc_id % 13 <> 0 AS active", "true AS active") + """ SELECT internal_id, CASE WHEN seen OR status IS NULL THEN true ELSE false END AS active,
    CASE WHEN status IS NULL THEN 1 ELSE 2 END AS state_version FROM diff""")
def runs(spark, sf):
    """Two runs arrive; the second repeats in a third marker and is skipped."""
    root = _folder(spark, "runs")
    first = all_postings(spark, sf).filter("doc_id % 11 <> 0")
    read = {"run-1": lambda: first, "run-2": lambda: current_postings(spark, sf)}
    schema = "run_id string, run_at timestamp"
    day = lambda n: F.timestamp_add("DAY", F.lit(n), F.lit("2024-01-01 06:00:00").cast("timestamp"))
    for i, run in enumerate(("run-1", "run-2", "run-2")):
        spark.range(1).select(F.lit(run).alias("run_id"), day(i).alias("run_at")).write.mode("append").json(f"{root}/markers")
    store = StateStore(spark, f"{root}/state")
    markers = spark.readStream.schema(schema).json(f"{root}/markers")
    stream_runs(markers, lambda run_id: read[run_id](), store, f"{root}/log", f"{root}/observations").awaitTermination()
    return store.load().select("internal_id", "active", "state_version")
