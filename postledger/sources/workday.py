"""Decoder of Workday search pages joined with optional detail pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import parse_iso, parse_posted_on
from ..functions.html import clean_html
from ..functions.predicates import LocationFilter
from ..functions.text import first_text
from ..operators.skew import top_n_per_group
from .landing import finish, option, option_is_on, responses

# --- fixed values: page size, limits and payload shapes ---------------------------
PAGE_SIZE = 20
MAX_JOBS = 1000
MAX_DETAIL_FETCHES = 1500
SEARCH_PAGE = (
    "struct<total bigint, jobPostings array<struct<title string, externalPath string, timeType string, "
    "locationsText string, postedOn string, bulletFields array<string>>>>"
)
DETAIL_PAGE = (
    "struct<jobPostingInfo struct<id string, title string, jobDescription string, location string, "
    "postedOn string, startDate string, timeType string, jobReqId string, externalUrl string>>"
)
# -----------------------------------------------------------------------------------

SOURCE = ["run_id", "company_id", "source_type", "source_key"]


def _max_jobs() -> Column:
    return F.coalesce(option("max_jobs").try_cast("int"), F.lit(MAX_JOBS))


def search_pages(landing: DataFrame) -> DataFrame:
    """All parsed search pages; the paging limit is for requests, not for what has landed."""
    return responses(landing, "workday", "search").withColumn("page", F.from_json("body", SEARCH_PAGE)).drop("body")


def search_plan(landing: DataFrame) -> DataFrame:
    """Pages to request for each search whose first page has landed, and the postings that the paging limit leaves out."""
    first = search_pages(landing).filter("page_seq = 0").select(*SOURCE, "search_term", F.coalesce("page.total", F.lit(0)).alias("total"), _max_jobs().alias("max_jobs"))
    wanted = F.least("total", "max_jobs")
    return first.groupBy(*SOURCE, "search_term").agg(F.max("total").alias("total"), F.min("max_jobs").alias("max_jobs")).select(
        *SOURCE, "search_term", "total", F.ceil(wanted / PAGE_SIZE).alias("pages"), (F.col("total") - wanted).alias("left_out"))


def search_summaries(landing: DataFrame) -> DataFrame:
    """One summary per posting path; the first search term and page wins."""
    rows = search_pages(landing).select(
        *SOURCE, "fetched_at", "options", F.coalesce("term_ord", F.lit(0)).alias("term_ord"), "page_seq",
        F.posexplode_outer("page.jobPostings").alias("pos", "summary"),
    ).filter(F.coalesce(F.col("summary.externalPath"), F.lit("")) != "")
    first = F.min_by(F.struct("summary", "fetched_at", "options"), F.struct("term_ord", "page_seq", "pos"))
    return (
        rows.withColumn("path", F.col("summary.externalPath"))
        .groupBy(*SOURCE, "path").agg(first.alias("first"))
        .select(*SOURCE, "path", "first.*")
        .withColumn("location", rules.summary_location(F.col("path"), F.col("summary.locationsText")))
    )


def search_completeness(landing: DataFrame) -> DataFrame:
    """Found and announced postings of each search, with a warning when short."""
    pages = search_pages(landing).withColumn("max_jobs", _max_jobs())
    totals = pages.groupBy(*SOURCE, "search_term").agg(
        F.sum(F.size(F.coalesce("page.jobPostings", F.array()))).alias("found"),
        F.coalesce(F.min_by("page.total", "page_seq"), F.lit(0)).alias("total"),
        F.min("max_jobs").alias("max_jobs"),
    )
    text = F.format_string("%s: collected %d of %d postings for search '%s' (max_jobs=%d)",
                           "company_id", "found", "total", F.coalesce("search_term", F.lit("")), "max_jobs")
    return totals.withColumn("warning", F.when(F.col("found") < F.col("total"), text))


def detail_targets(summaries: DataFrame, where: LocationFilter | None = None,
                   cap: int = MAX_DETAIL_FETCHES) -> DataFrame:
    """Paths whose detail page is to be requested: places are filtered before the
    cap, and the cap takes paths in sorted order so that it picks the same ones
    each run. Details that have landed are all used, whatever this plan says."""
    kept = summaries if where is None else summaries.filter(where.matches(F.col("location")))
    return top_n_per_group(kept.select(*SOURCE, "path"), SOURCE, [F.col("path")], cap, F.col("path"))


def detail_cap_warnings(summaries: DataFrame, where: LocationFilter | None = None,
                        cap: int = MAX_DETAIL_FETCHES) -> DataFrame:
    kept = summaries if where is None else summaries.filter(where.matches(F.col("location")))
    text = F.format_string("%s: fetched descriptions for %d of %d postings (max_detail_fetches=%d)",
                           "company_id", F.lit(cap), "n", F.lit(cap))
    counts = kept.groupBy(*SOURCE).agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    return counts.select(*SOURCE, text.alias("warning"))


def details(landing: DataFrame) -> DataFrame:
    """Detail records by path; a failed or empty response is simply absent."""
    info = F.from_json("body", DETAIL_PAGE)["jobPostingInfo"]
    return (
        responses(landing, "workday", "detail")
        .select(*SOURCE, F.col("request_path").alias("path"), info.alias("detail"), "page_seq")
        .groupBy(*SOURCE, "path")
        .agg(F.max_by("detail", F.when(F.col("detail").isNotNull(), F.col("page_seq"))).alias("detail"))
        .filter(F.col("detail").isNotNull())
    )


def workday_rows(landing: DataFrame, retain_raw: bool = False, where: LocationFilter | None = None) -> DataFrame:
    """Summaries with their optional detail, every landed one. Identity and place
    come from the summary alone, so a missing detail never moves a posting."""
    summaries = search_summaries(landing)
    if where is not None:
        summaries = summaries.filter(where.matches(F.col("location")))
    rows = summaries.join(details(landing), [*SOURCE, "path"], "left")
    c = F.col
    site = rules.tenant_coordinates(option("tenant"), option("wd_host"), option("site"), c("source_key"))
    rows = rows.withColumn("at", site)
    own_url = F.concat(F.lit("https://"), c("at.tenant"), F.lit("."), c("at.host"),
                       F.lit(".myworkdayjobs.com/"), c("at.site"), c("path"))
    raw = F.when(option_is_on("store_raw"), F.to_json(F.struct("summary", "detail"))) if retain_raw \
        else F.lit(None).cast("string")
    started = parse_iso(c("detail.startDate"))
    relative = F.coalesce(c("detail.postedOn"), c("summary.postedOn"))
    text = rows.withColumns({
        "source_job_id": rules.requisition_id(c("path"), c("detail.jobReqId")),
        "company_name": c("company_id"),
        "title": first_text(c("detail.title"), c("summary.title")),
        "description_text": F.coalesce(clean_html(c("detail.jobDescription")), F.lit("")),
        "apply_url": first_text(c("detail.externalUrl"), own_url),
        "date_posted": F.coalesce(started, parse_posted_on(relative, c("fetched_at"))),
        "date_posted_raw": F.when(started.isNotNull(), c("detail.startDate")).otherwise(relative),
        "time_type": first_text(c("detail.timeType"), c("summary.timeType")),
        "raw": raw,
        "reject_reason": F.lit(None).cast("string"),
    })
    return finish(text.withColumns({
        "source_url": c("apply_url"),
        "employment_type": rules.workday_employment(c("time_type"), c("title")),
        "remote_status": rules.workday_remote(c("location"), c("title")),
    }))
