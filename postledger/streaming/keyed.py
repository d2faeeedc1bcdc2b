"""Per-key status of arriving postings and pages. The last row of each key is a
table in parts; every micro-batch is compared with the parts of its keys by windows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.predicates import MIN_MEANINGFUL_CHARS, meaningful
from ..functions.records import keywords_found
from ..operators.watch import added_lines
from ..session import cut_lineage
from ..sinks.state import KeyedStore

ARRIVAL_STATE = "internal_id string, observed_at timestamp, seq long, content_hash string, closed boolean"
PAGE_STATE = "id string, checked_at timestamp, seq long, content_text string, content_hash string, last_changed_at timestamp"


def _each_batch(stream: DataFrame, store: KeyedStore, schema: str, out: str, checkpoint: str, step) -> StreamingQuery:
    """Run ``step(batch, state)`` on every micro-batch; it returns the rows to
    write under ``out/batch=N`` and the next state of the batch's parts. The batch is read from its
    source once, and only the parts of its keys are read and written. A batch that comes again
    after a failure writes the same folder and is not counted in twice."""
    def fold(batch: DataFrame, number: int) -> None:
        fresh = cut_lineage(store.with_part(batch))
        # at most as many numbers as the store has parts
        touched = sorted(r.part for r in fresh.select("part").distinct().collect())
        rows, state = step(fresh.drop("part"), store.load(schema, touched, number))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if not store.has_batch(number):
            store.commit(state, number, touched)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrival_status(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status of each arrival against the one before it, and the last arrival of each key.

    ``batch`` has ``internal_id, observed_at, seq, content_hash, closed``. A row
    with ``closed`` set ends the posting (status expired); expiry by absence
    needs a whole run and is part of the run fold.
    """
    names = ["internal_id", "observed_at", "seq", "content_hash", "closed"]
    both = state.select(*names, F.lit(False).alias("fresh")).unionByName(batch.select(*names, F.lit(True).alias("fresh")))
    order = Window.partitionBy("internal_id").orderBy("fresh", "observed_at", "seq")
    before = F.lag(F.struct("content_hash", "closed")).over(order)
    status = (
        F.when(F.col("closed"), F.lit("expired")).when(F.col("before").isNull(), F.lit("new")).when(F.col("before.closed"), F.lit("reopened"))
        .when(F.col("content_hash") == F.col("before.content_hash"), F.lit("unchanged")).otherwise(F.lit("changed")))
    rows = both.withColumn("before", before).filter("fresh").select("internal_id", "observed_at", "seq", "content_hash", status.alias("status"))
    last = F.max_by(F.struct(*names[1:]), F.struct("fresh", "observed_at", "seq"))
    return rows, both.groupBy("internal_id").agg(last.alias("l")).select("internal_id", "l.*")


def stream_status(arrivals: DataFrame, store: KeyedStore, out: str, checkpoint: str) -> StreamingQuery:
    """Status of each arrival as it comes: new, changed, unchanged, reopened or expired."""
    return _each_batch(arrivals, store, ARRIVAL_STATE, out, checkpoint, arrival_status)


def page_outcomes(batch: DataFrame, state: DataFrame, min_chars: int = MIN_MEANINGFUL_CHARS) -> tuple[DataFrame, DataFrame]:
    """Outcome of each page check against the last good one before it, and the last good text of each page.

    ``batch`` has ``id, seq, checked_at, content_text, content_hash, check_error,
    keywords`` (see ``operators.watch.page_texts``).
    """
    null = F.lit(None).cast("string")
    stored = state.select("id", "seq", "checked_at", "content_text", "content_hash", null.alias("check_error"),
                          F.lit(None).cast("array<string>").alias("keywords"), "last_changed_at", F.lit(False).alias("fresh"))
    new = batch.select("id", "seq", "checked_at", "content_text", "content_hash", "check_error", "keywords",
                       F.lit(None).cast("timestamp").alias("last_changed_at"), F.lit(True).alias("fresh"))
    order = Window.partitionBy("id").orderBy("fresh", "checked_at", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("check_error").isNull() & F.col("content_hash").isNotNull()
    # written once: the line comparison and the outcome both read it
    seen = cut_lineage(stored.unionByName(new).withColumns({
        "known": F.row_number().over(order) > 1,
        "previous": F.last(F.when(good, F.struct("content_hash", "content_text")), ignorenulls=True).over(before),
        "key": F.struct("id", "fresh", "checked_at", "seq"),
    }))
    differs = F.col("fresh") & F.col("check_error").isNull() & F.col("known") & ~F.col("content_hash").eqNullSafe(F.col("previous.content_hash"))
    added = added_lines(seen.filter(differs).select(F.col("key").alias("id"), "content_text", F.col("previous.content_text").alias("previous_text"))).select(
        F.col("id").alias("key"), "added_text")
    status = (
        F.when(F.col("check_error").isNotNull(), F.lit("error")).when(~F.col("known"), F.lit("new"))
        .when(differs & meaningful(F.coalesce("added_text", F.lit("")), min_chars), F.lit("changed")).otherwise(F.lit("unchanged")))
    text = F.when(F.col("status") == "changed", F.coalesce("added_text", F.lit(""))).otherwise(F.lit(""))
    moved = F.when(F.col("fresh"), F.when(F.col("status").isin("new", "changed"), F.col("checked_at"))).otherwise(F.col("last_changed_at"))
    judged = seen.join(added, "key", "left").withColumn("status", status).withColumn("added_text", text).withColumn(
        "changed_at", F.last(moved, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = judged.filter("fresh").select(
        "id", "seq", "checked_at", "status", "added_text", F.array_join(keywords_found(F.col("added_text"), F.col("keywords")), ", ").alias("keywords_found"),
        F.when(F.col("status") != "error", F.col("changed_at")).alias("last_changed_at"), F.coalesce("check_error", F.lit("")).alias("error"))
    at = F.struct("fresh", "checked_at", "seq")
    kept = judged.groupBy("id").agg(
        F.max_by(F.struct("checked_at", "seq"), at).alias("l"), F.max_by("changed_at", at).alias("last_changed_at"),
        F.max_by(F.struct("content_text", "content_hash"), F.when(good, at)).alias("g"))
    return rows, kept.select("id", "l.checked_at", "l.seq", "g.content_text", "g.content_hash", "last_changed_at")


def stream_watch_diff(checks: DataFrame, store: KeyedStore, out: str, checkpoint: str, min_chars: int = MIN_MEANINGFUL_CHARS) -> StreamingQuery:
    """Outcome of each page check as it comes."""
    return _each_batch(checks, store, PAGE_STATE, out, checkpoint, lambda batch, state: page_outcomes(batch, state, min_chars))
