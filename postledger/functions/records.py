"""Text forms of postings and watched pages."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import iso_day
from .text import cap_description, escape_terminator, flatten_scalar, strip

# --- fixed values: formats, limits and report groups ------------------------------
MAX_DESCRIPTION_CHARS = 2000
MARKDOWN_DESCRIPTION_CHARS = 500
SOFTWARE_QA = ("Software development", "QA and testing")
TRADES = ("Electrical trade", "HVAC trade", "Construction and general labor")
AREA_MARKERS = ("Austin", "Round Rock", "Georgetown", "Texas", "TX")
JOB_END, WATCH_END = "END JOB", "END WATCH"
# ----------------------------------------------------------------------------------


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def job_record(max_chars: int = MAX_DESCRIPTION_CHARS) -> Column:
    """Delimited record of a posting row with a ``status``; ends with a blank line."""
    c = F.col
    source = flatten_scalar(c("source_id"))
    return _lines(
        F.lit("JOB"),
        _field("id", F.concat(source, F.lit("|"), flatten_scalar(c("source_job_id")))),
        _field("company", flatten_scalar(c("company_name"))),
        _field("title", flatten_scalar(c("title"))),
        _field("location", flatten_scalar(c("location"))),
        _field("employment_type", flatten_scalar(c("employment_type"))),
        _field("remote", flatten_scalar(c("remote_status"))),
        _field("status", flatten_scalar(c("status"))),
        _field("posted_date", iso_day(c("date_posted"))),
        _field("first_seen", iso_day(c("first_seen_at"))),
        _field("source", source),
        _field("salary", flatten_scalar(c("salary_text"))),
        _field("apply_url", flatten_scalar(c("apply_url"))),
        F.lit("description:"),
        escape_terminator(cap_description(c("description_text"), max_chars), JOB_END),
        F.lit(JOB_END),
        F.lit(""),
    )


def watch_record(max_chars: int = MAX_DESCRIPTION_CHARS) -> Column:
    """Delimited record of a watched page; ends with a blank line."""
    c = F.col
    return _lines(
        F.lit("WATCH"),
        _field("id", c("id")),
        _field("name", flatten_scalar(c("name"))),
        _field("url", c("url")),
        _field("status", c("status")),
        _field("keywords_found", F.array_join(c("keywords_found"), ", ")),
        _field("last_changed", iso_day(c("last_changed_at"))),
        _field("error", flatten_scalar(c("error"))),
        F.lit("added_text:"),
        escape_terminator(cap_description(c("added_text"), max_chars), WATCH_END),
        F.lit(WATCH_END),
        F.lit(""),
    )


def record_bytes(record: Column) -> Column:
    """Bytes a record takes in a message, with the line end after it."""
    return F.octet_length(record) + F.lit(1)


def keywords_found(text: Column, keywords: Column) -> Column:
    """Keywords that occur in the text, in their own order and spelling."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.coalesce(keywords, F.array().cast("array<string>")),
                    lambda k: lowered.contains(F.lower(k)))


def markdown_bucket(category: Column, location: Column) -> Column:
    """Report group of a new posting: 1 software, 2 trades, 3 area, 4 other."""
    in_area = F.lit(False)
    for marker in AREA_MARKERS:
        in_area = in_area | location.contains(marker)
    return (
        F.when(category.isin(*SOFTWARE_QA), F.lit(1))
        .when(category.isin(*TRADES), F.lit(2))
        .when(in_area, F.lit(3))
        .otherwise(F.lit(4))
    )


def markdown_posting() -> Column:
    """Full markdown block of one posting."""
    c = F.col

    def present(name: str) -> Column:
        return F.coalesce(c(name), F.lit("")) != ""

    text = c("description_text")
    shortened = F.when(F.length(text) > MARKDOWN_DESCRIPTION_CHARS,
                       F.concat(F.substring(text, 1, MARKDOWN_DESCRIPTION_CHARS), F.lit("..."))).otherwise(text)
    return _lines(
        F.concat(F.lit("\n### "), c("title")),
        F.concat(F.lit("**"), c("company_name"), F.lit("** | "), c("location")),
        F.when(present("employment_type"), F.concat(F.lit("*"), c("employment_type"), F.lit("*"))),
        F.when(present("remote_status"), F.concat(F.lit("*Remote: "), c("remote_status"), F.lit("*"))),
        F.when(present("salary_text"), F.concat(F.lit("**Salary:** "), c("salary_text"))),
        F.when(F.size(c("warning_flags")) > 0,
               F.concat(F.lit("⚠️ **Warnings:** "), F.array_join(c("warning_flags"), ", "))),
        F.when(present("description_text"), F.concat(F.lit("\n"), shortened)),
        F.concat(F.lit("[Apply]("), c("apply_url"), F.lit(")")),
    )


def markdown_line() -> Column:
    """Compact one-line form used for the catch-all group."""
    c = F.col
    return F.concat(F.lit("- ["), c("title"), F.lit("]("), c("apply_url"), F.lit(") — "),
                    c("company_name"), F.lit(", "), c("location"))
