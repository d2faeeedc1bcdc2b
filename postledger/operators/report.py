"""Report rows: a machine-readable form and a markdown form."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import markdown_bucket, markdown_line, markdown_posting

# --- fixed values: texts of the report; sections in order, with the bucket of new postings they show ------
_TITLE = "# Job Collection Report"
_GENERATED = "\n**Generated:** "
_CHECKED = "**Sources checked:** {sources}"
_STATUS = "**Status:** {successful} successful, {failed} failed"
_HEADING = "\n## %s (%d)"
_GONE = "%d jobs are no longer posted"
_PROBLEM = "- **%s (%s)**: %s"
_CHANGED_TITLE, _EXPIRED_TITLE, _PROBLEMS_TITLE = "Changed Jobs", "Expired Jobs", "Collection Problems"
REPORT_DESCRIPTION_CHARS = 2000
REPORTED = ("new", "changed", "expired")
_HEADER, _CHANGED, _EXPIRED, _PROBLEMS = 0, 5, 6, 7
_SECTIONS = (
    (1, 1, "New Software & QA Jobs"),
    (2, 3, "New Austin-Area Technical Jobs"),
    (3, 2, "New Trades & Immediate Income Jobs"),
    (4, 4, "Other New Jobs"),
)
_COMPACT_BUCKET = 4
# -------------------------------------------------------------------------------------


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def json_rows(postings: DataFrame) -> DataFrame:
    """Reported postings in the report's field names."""
    return postings.filter(F.col("status").isin(*REPORTED)).select(
        "status", F.col("source_type").alias("source"), F.col("source_job_id").alias("source_id"),
        F.col("company_name").alias("company"), "title", "location", "employment_type", "remote_status",
        F.col("salary_text").alias("salary"),
        F.substring("description_text", 1, REPORT_DESCRIPTION_CHARS).alias("description"), "apply_url",
        _iso("date_posted").alias("posted_date"), _iso("first_seen_at").alias("first_seen"),
        F.col("warning_flags").alias("warnings"),
    )


def json_header(generated_at: Column, stats: DataFrame) -> DataFrame:
    """One row that describes the run."""
    return stats.select(F.struct(
        F.concat(F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("generated_at"),
        F.lit("success").alias("status"), "source_count", "successful_sources", "failed_sources",
    ).alias("run"))


def markdown_rows(postings: DataFrame, generated_at: Column, sources: int, successful: int, failed: int,
                  source_errors: DataFrame | None = None) -> DataFrame:
    """Report lines as rows ``(section_ord, section, row_ord, sort_key, internal_id, line)``.

    Ordered by the first, third and fourth column they form the report. Empty
    sections produce no rows; the heading of a section counts its postings.
    """
    header = postings.sparkSession.range(1).select(
        F.lit(_HEADER).alias("section_ord"), F.lit("header").alias("section"),
        F.posexplode(F.array(
            F.lit(_TITLE),
            F.concat(F.lit(_GENERATED), F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
            F.lit(_CHECKED.format(sources=sources)),
            F.lit(_STATUS.format(successful=successful, failed=failed)),
        )).alias("row_ord", "line"),
    ).select("section_ord", "section", "row_ord", F.lit("").alias("sort_key"), F.lit(None).cast("string").alias("internal_id"), "line")

    bucket = markdown_bucket(F.col("category"), F.col("location"))
    order = F.when(F.col("status") == "changed", F.lit(_CHANGED)).when(F.col("status") == "expired", F.lit(_EXPIRED))
    title = F.when(F.col("status") == "changed", F.lit(_CHANGED_TITLE)).when(F.col("status") == "expired", F.lit(_EXPIRED_TITLE))
    for place, shown, name in _SECTIONS:
        order = order.when(bucket == shown, F.lit(place))
        title = title.when(bucket == shown, F.lit(name))
    compact = (F.col("status") == "new") & (bucket == _COMPACT_BUCKET)
    line = F.when(compact, markdown_line()).otherwise(markdown_posting())
    shown = postings.filter(F.col("status").isin(*REPORTED)).select(
        order.alias("section_ord"), title.alias("section"), F.lit(1).alias("row_ord"),
        F.concat_ws("\u0001", "company_name", "title", "internal_id").alias("sort_key"), "internal_id", line.alias("line"))
    counts = shown.groupBy("section_ord", "section").agg(F.count("*").alias("n"))
    heading = counts.select(
        "section_ord", "section", F.lit(0).alias("row_ord"), F.lit("").alias("sort_key"),
        F.lit(None).cast("string").alias("internal_id"),
        F.format_string(_HEADING, "section", "n").alias("line"))
    gone = counts.filter(F.col("section_ord") == _EXPIRED).select(
        "section_ord", "section", F.lit(1).alias("row_ord"), F.lit("").alias("sort_key"),
        F.lit(None).cast("string").alias("internal_id"), F.format_string(_GONE, "n").alias("line"))
    parts = [header, heading, shown.filter(F.col("section_ord") != _EXPIRED), gone]
    if source_errors is not None:
        problems = source_errors.select(
            F.lit(_PROBLEMS).alias("section_ord"), F.lit(_PROBLEMS_TITLE).alias("section"), F.lit(1).alias("row_ord"),
            F.concat_ws("\u0001", "source_id", "run_id").alias("sort_key"), F.lit(None).cast("string").alias("internal_id"),
            F.format_string(_PROBLEM, "company_id", "source_type", "error").alias("line"))
        n = problems.groupBy("section_ord", "section").agg(F.count("*").alias("n"))
        parts += [problems, n.select(
            "section_ord", "section", F.lit(0).alias("row_ord"), F.lit("").alias("sort_key"),
            F.lit(None).cast("string").alias("internal_id"), F.format_string(_HEADING, "section", "n").alias("line"))]
    return reduce(DataFrame.unionByName, parts)
