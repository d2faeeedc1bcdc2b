"""Counts and health figures. Every aggregate combines within tasks first."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import markdown_bucket
from ..functions.rules import tenant_coordinates
from ..functions.text import source_id
from ..sources.landing import unreadable
from .skew import salted_join

COUNTED = ("new", "changed", "unchanged", "expired", "reopened")


def run_statistics(diff: DataFrame) -> DataFrame:
    """One row: postings per transition and in total."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in COUNTED]
    return diff.agg(*counts, F.count("status").alias("total"))


def status_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("status").agg(F.count("*").alias("postings"))


def bucket_counts(postings: DataFrame) -> DataFrame:
    """New postings per report group."""
    new = postings.filter(F.col("status") == "new")
    return new.groupBy(markdown_bucket(F.col("category"), F.col("location")).alias("bucket")).agg(
        F.count("*").alias("postings"))


def filter_effect(postings: DataFrame, keep: Column) -> DataFrame:
    """How many postings a place filter keeps and drops."""
    kept = F.count_if(keep)
    return postings.agg(kept.alias("kept"), (F.count("*") - kept).alias("dropped"))


def postings_per_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source_id").agg(F.countDistinct("source_job_id").alias("postings"))


def _response_error() -> Column:
    """Message of a failed response; a likely wrong site id gets a hint. The texts are fixed values."""
    at = tenant_coordinates(F.lit(None).cast("string"), F.lit(None).cast("string"),
                            F.lit(None).cast("string"), F.col("source_key"))
    hint = F.when(
        (F.col("source_type") == "workday") & F.col("http_status").isin(404, 422),
        F.concat(F.lit(" -- '"), F.coalesce(at["site"], F.lit("")), F.lit("' is likely the wrong site id for tenant '"),
                 F.coalesce(at["tenant"], F.lit("")), F.lit("'; check the path in the public careers URL")),
    ).otherwise(F.lit(""))
    by_status = F.when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)),
                       F.concat(F.lit("HTTP error: "), F.coalesce(F.col("http_status").cast("string"), F.lit("no response")), hint))
    return F.coalesce(F.col("error"), by_status, F.concat(F.lit("unreadable response: "), F.col("unreadable")))


def response_errors(landing: DataFrame) -> DataFrame:
    """Failed and unreadable responses. A failed detail page does not fail its source.

    ``landing`` may be judged already (:func:`..sources.landing.judged`), so that bodies are parsed once."""
    pages = landing.filter(F.col("page_kind") != "detail")
    if "unreadable" not in landing.columns:
        pages = pages.withColumn("unreadable", unreadable())
    return (
        pages
        .select("run_id", source_id(F.col("company_id"), F.col("source_type")).alias("source_id"),
                "company_id", "source_type", "page_seq", "http_status", _response_error().alias("message"))
        .filter(F.col("message").isNotNull())
    )


def source_errors(landing: DataFrame) -> DataFrame:
    """One row per source with its distinct messages joined by ``; ``.

    Repeats are counted away first, so what is joined is the set of different
    messages of a source, not its failed responses.
    """
    distinct = response_errors(landing).groupBy("run_id", "source_id", "company_id", "source_type", "message").agg(
        F.min("page_seq").alias("first_page"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("first_page", "message")))
    return distinct.groupBy("run_id", "source_id", "company_id", "source_type").agg(
        F.array_join(F.transform(listed, lambda e: e["message"]), "; ").alias("error"),
        F.sum("n").alias("failed_responses"),
    )


def source_runs(landing: DataFrame, postings: DataFrame) -> DataFrame:
    """Outcome of each source in each run."""
    failed = response_errors(landing).groupBy("run_id", "source_id").agg(
        F.min_by(F.struct("message", "http_status"), F.struct("page_seq", "message")).alias("e"))
    pages = landing.select("run_id", "company_id", "source_type", "http_status", "fetched_at", "page_kind").groupBy(
        "run_id", "company_id", "source_type").agg(
        F.max(F.when(F.col("page_kind") != "detail", F.col("http_status"))).alias("http_status"),
        (F.max("fetched_at").cast("timestamp").cast("double") - F.min("fetched_at").cast("timestamp").cast("double")).alias("duration_seconds"),
        F.max("fetched_at").alias("finished_at"),
    ).withColumn("source_id", source_id(F.col("company_id"), F.col("source_type")))
    jobs = postings.groupBy("run_id", "source_id").agg(F.count("*").alias("job_count"))
    return (
        pages.join(failed, ["run_id", "source_id"], "left").join(jobs, ["run_id", "source_id"], "left")
        .select(
            "run_id", "source_id", "company_id", "source_type", "finished_at",
            F.when(F.col("e").isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
            F.coalesce("job_count", F.lit(0)).alias("job_count"),
            F.col("e.message").alias("error"),
            F.when(F.col("e").isNull(), F.col("http_status"))
            .otherwise(F.coalesce(F.col("e.http_status"), F.lit(500))).alias("http_status"),
            "duration_seconds",
        )
    )


def collection_stats(enabled: DataFrame, runs: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row for the run: sources and transitions. The three inputs are one-row
    aggregates, taken as scalar subqueries."""
    n = enabled.agg(F.count("*")).scalar()
    r = runs.agg(F.struct(F.count_if(F.col("status") == "success").alias("ok"),
                          F.count_if(F.col("status") != "success").alias("bad"))).scalar()
    return statistics.select(
        n.alias("source_count"), r["ok"].alias("successful_sources"), r["bad"].alias("failed_sources"),
        F.col("new").alias("new_count"), F.col("changed").alias("changed_count"), F.col("expired").alias("expired_count"),
    )


def source_health(runs: DataFrame) -> DataFrame:
    """Last attempt, last success, last state and current failure streak.

    ``runs`` has ``source_id, run_id, finished_at, status, error``. The streak is
    the number of failures after the last success: a combining count against
    one row per source, not an ordered walk over the runs of a source.
    """
    order = F.struct("finished_at", "run_id")
    success = F.col("status") == "success"
    newest = F.max_by(F.struct("status", "error"), order)
    last = runs.groupBy("source_id").agg(
        F.max("finished_at").alias("last_attempted_at"),
        F.max(F.when(success, F.col("finished_at"))).alias("last_successful_at"),
        F.max(F.when(success, order)).alias("_since"),
        newest.alias("_last"),
    )
    # the failures in front, counted by source and distance from the last success
    since = last.select("source_id", "_since")
    failures = runs.filter(~success).select("source_id", order.alias("_at"))
    streak = (
        salted_join(failures, since, ["source_id"], "inner", F.col("_at.run_id"))
        .filter(F.col("_since").isNull() | (F.col("_at") > F.col("_since")))
        .groupBy("source_id").agg(F.count("*").alias("consecutive_failures"))
    )
    return last.join(streak, "source_id", "left").select(
        "source_id", "last_attempted_at", "last_successful_at",
        F.col("_last.status").alias("last_status"),
        F.when(F.col("_last.status") != "success", F.col("_last.error")).alias("last_error"),
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
    )


def watch_counts(watches: DataFrame) -> DataFrame:
    return watches.agg(F.count("*").alias("watches_checked"),
                       F.count_if(F.col("status") == "changed").alias("watches_changed"))


def discovery_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("discovery_result").agg(F.count("*").alias("companies"))


def run_log_row(stats: DataFrame, run_id: str, started_at: Column, ended_at: Column,
                report_path: str | None = None, delivery_status: str | None = None) -> DataFrame:
    """Run log entry from the run's statistics."""
    return stats.select(
        F.lit(run_id).alias("run_id"),
        started_at.cast("timestamp_ntz").alias("start_time"),
        ended_at.cast("timestamp_ntz").alias("end_time"),
        F.lit("success").alias("status"),
        "source_count", "successful_sources", "failed_sources", "new_count", "changed_count", "expired_count",
        F.lit(report_path).cast("string").alias("report_path"),
        F.lit(delivery_status).cast("string").alias("delivery_status"),
    )
