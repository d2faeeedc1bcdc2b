"""Checks of configuration and state; every finding is a row."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import EMPLOYMENT_TYPES, REMOTE_STATUSES, SOURCE_TYPES, STATUSES
from .skew import salted_join


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def registry_errors(raw: DataFrame) -> DataFrame:
    """Problems of the configured companies, as ``(company_id, error)``. The texts are fixed values."""
    one = raw.select("id", F.coalesce("name", "id", F.lit("")).alias("name"),
                     F.coalesce(F.size("sources"), F.lit(0)).alias("n"), "sources")
    sources = one.select("id", F.explode("sources").alias("s")).select("id", "s.*")
    label = F.concat(F.lit("Company "), F.coalesce("id", F.lit("")))
    missing = lambda kind, field: F.when(
        (F.col("type") == kind) & _blank(field), F.concat(label, F.lit(f": {kind} source is missing {field}")))
    no_site = (_blank("tenant") | _blank("site")) & _blank("site_url")
    findings = F.array(
        F.when(~F.coalesce(F.col("type").isin(*SOURCE_TYPES), F.lit(False)),
               F.concat(F.lit("Unknown source type: "), F.coalesce("type", F.lit("")))),
        F.when((F.col("type") == "workday") & no_site, F.concat(
            label, F.lit(": workday source needs tenant + site (or a site_url to derive them from)"))),
        missing("greenhouse", "board_token"), missing("lever", "board_name"), missing("ashby", "board_name"),
        missing("jsonld", "site_url"),
    )
    empty = raw.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("company_id"), F.lit("No companies configured").alias("error"))
    companies = one.select(F.col("id").alias("company_id"), F.explode(F.array_compact(F.array(
        F.when(_blank("id"), F.concat(F.lit("Company missing ID: "), "name")),
        F.when(F.col("n") <= 0, F.concat(label, F.lit(" has no sources"))),
    ))).alias("error"))
    per_source = sources.select(F.col("id").alias("company_id"), F.explode(F.array_compact(findings)).alias("error"))
    return empty.unionByName(companies).unionByName(per_source)


def orphans(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings whose source is not registered."""
    return salted_join(postings, sources.select("source_id").distinct(), ["source_id"], "left_anti",
                       F.col("source_job_id"))


def repeated_keys(state: DataFrame) -> DataFrame:
    """Keys and ids that should be unique and are not."""
    found = []
    for name, cols in (("source_id, source_job_id", ["source_id", "source_job_id"]), ("internal_id", ["internal_id"])):
        found.append(state.groupBy(*cols).agg(F.count("*").alias("rows")).filter("rows > 1").select(
            F.lit(name).alias("key"), F.concat_ws("#", *cols).alias("value"), "rows"))
    return found[0].unionByName(found[1])


def domain_errors(postings: DataFrame) -> DataFrame:
    """Values outside the allowed set of a coded column, with their counts."""
    allowed = {"status": STATUSES, "remote_status": REMOTE_STATUSES, "employment_type": EMPLOYMENT_TYPES}
    bad = [
        F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))
        for c, values in allowed.items() if c in postings.columns
    ]
    return (
        postings.select(F.explode(F.array_compact(F.array(*bad))).alias("e"))
        .groupBy("e.column", "e.value").agg(F.count("*").alias("rows"))
    )


def warnings(completeness: DataFrame, detail_caps: DataFrame, rejected: DataFrame,
             omitted: DataFrame | None = None, unreadable: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
    """Every cap, omission and drop of a run as ``(kind, subject, warning)``.

    ``unreadable`` are responses that could not be decoded, ``late`` the rows that a stream put aside,
    of which there is one warning for each window.
    """
    parts = [
        completeness.filter(F.col("warning").isNotNull()).select(
            F.lit("short search").alias("kind"), F.concat_ws("#", "company_id", "source_type").alias("subject"), "warning"),
        detail_caps.select(F.lit("detail cap").alias("kind"),
                           F.concat_ws("#", "company_id", "source_type").alias("subject"), "warning"),
        rejected.select(F.lit("rejected row").alias("kind"), F.col("source_id").alias("subject"),
                        F.col("reject_reason").alias("warning")),
    ]
    if omitted is not None:
        parts.append(omitted.filter("omitted > 0").select(
            F.lit("feed limit").alias("kind"), F.lit("feed").alias("subject"),
            F.format_string("%d of %d records left out", "omitted", "offered").alias("warning")))
    if unreadable is not None:
        place = F.concat_ws(" ", "page_kind", F.coalesce("request_path", F.concat(F.lit("page "), F.col("page_seq").cast("string"))))
        parts.append(unreadable.select(F.lit("unreadable response").alias("kind"), F.col("source_id").alias("subject"),
                                       F.concat(place, F.lit(": "), F.col("reject_reason")).alias("warning")))
    if late is not None:
        window = F.coalesce(F.date_format("window_start", "yyyy-MM-dd HH:mm"), F.lit("no time"))
        parts.append(late.groupBy(window.alias("subject")).agg(F.count("*").alias("n")).select(
            F.lit("late rows").alias("kind"), "subject", F.format_string("%d rows came after their window was closed", "n").alias("warning")))
    return reduce(DataFrame.unionByName, parts)


__all__ = ["domain_errors", "orphans", "registry_errors", "repeated_keys", "warnings"]
