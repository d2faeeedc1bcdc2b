"""Decoders of whole-board JSON payloads: Greenhouse, Lever and Ashby."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import epoch_millis, parse_iso
from ..functions.html import clean_html
from ..functions.predicates import listed
from ..functions.text import blank_to_null, first_text, strip
from .landing import finish, json_elements, missing_id, responses

# --- fixed values: payload shapes (numbers kept as text keep their spelling) -----
GREENHOUSE_JOB = (
    "struct<id string, title string, company struct<name string>, location struct<name string>, "
    "offices array<struct<name string, location string>>, departments array<struct<name string>>, "
    "first_published string, published_at string, updated_at string, content string, absolute_url string>"
)
LEVER_JOB = (
    "struct<id string, text string, categories struct<commitment string, department string, "
    "location string, team string, allLocations array<string>>, createdAt string, hostedUrl string, "
    "applyUrl string, description string, descriptionPlain string, additionalPlain string, "
    "workplaceType string>"
)
ASHBY_JOB = (
    "struct<id string, title string, location string, secondaryLocations array<string>, "
    "department string, team string, employmentType string, publishedAt string, createdAt string, "
    "updatedAt string, jobUrl string, applyUrl string, descriptionPlain string, descriptionHtml string, "
    "isRemote boolean, isListed boolean, workplaceType string, "
    "compensation struct<compensationTierSummary string, scrapeableCompensationSalarySummary string, "
    "min string, max string, currency string, period string>>"
)
NO_PLACE = "Remote"
# -----------------------------------------------------------------------------------


def _joined_names(array, pick):
    named = F.filter(F.transform(array, pick), lambda x: x.isNotNull())
    return F.array_join(named, ", ")


def greenhouse_rows(landing: DataFrame, retain_raw: bool = False) -> DataFrame:
    """Every posting of the boards, each with a reject reason or null."""
    rows = json_elements(responses(landing, "greenhouse", "board"), "jobs", GREENHOUSE_JOB, retain_raw)
    office = lambda o: F.coalesce(blank_to_null(o["location"]), blank_to_null(o["name"]))
    dates = [F.col(f"j.{n}") for n in ("first_published", "published_at", "updated_at")]
    description = F.when(F.coalesce(F.col("j.content"), F.lit("")) != "", clean_html(F.col("j.content")))
    text = rows.withColumns({
        "source_job_id": F.col("j.id"),
        "company_name": F.coalesce(F.col("j.company.name"), F.col("company_id")),
        "title": F.coalesce(F.col("j.title"), F.lit("")),
        "location": first_text(F.col("j.location.name"), _joined_names(F.col("j.offices"), office), F.lit(NO_PLACE)),
        "department": _joined_names(F.col("j.departments"), lambda d: blank_to_null(d["name"])),
        "description_text": F.coalesce(description, F.lit("")),
        "date_posted": parse_iso(*dates),
        "date_posted_raw": F.coalesce(*[F.when(parse_iso(d).isNotNull(), d) for d in dates]),
        "apply_url": F.coalesce(F.col("j.absolute_url"), F.lit("")),
        "employment_type": F.lit("full_time"),
        "reject_reason": missing_id(F.col("j.id")),
    })
    return finish(text.withColumns({
        "source_url": F.col("apply_url"),
        "remote_status": rules.greenhouse_remote(F.col("title"), F.col("description_text")),
    }))


def lever_rows(landing: DataFrame, retain_raw: bool = False) -> DataFrame:
    """The payload is a flat array; any other body holds no postings."""
    rows = json_elements(responses(landing, "lever", "board"), None, LEVER_JOB, retain_raw)
    c = F.col
    main = first_text(c("j.descriptionPlain"), clean_html(c("j.description")))
    extra = F.coalesce(c("j.additionalPlain"), F.lit(""))
    posted = epoch_millis(c("j.createdAt"))
    return finish(rows.withColumns({
        "source_job_id": c("j.id"),
        "company_name": c("company_id"),
        "title": F.coalesce(c("j.text"), F.lit("")),
        "location": first_text(c("j.categories.location"),
                               F.array_join(c("j.categories.allLocations"), ", "), F.lit(NO_PLACE)),
        "description_text": F.when(extra != "", strip(F.concat(main, F.lit("\n\n"), extra))).otherwise(main),
        "department": first_text(c("j.categories.department")),
        "team": first_text(c("j.categories.team")),
        "employment_type": rules.lever_employment(c("j.categories.commitment")),
        "remote_status": rules.lever_remote(c("j.workplaceType")),
        "workplace_type": first_text(c("j.workplaceType")),
        "date_posted": posted,
        "date_posted_raw": F.when(posted.isNotNull(), c("j.createdAt")),
        "apply_url": first_text(c("j.applyUrl"), c("j.hostedUrl")),
        "source_url": first_text(c("j.hostedUrl"), c("j.applyUrl")),
        "reject_reason": missing_id(c("j.id")),
    }))


def ashby_rows(landing: DataFrame, retain_raw: bool = False) -> DataFrame:
    """Unlisted postings are left out; pay comes from the summary text if given."""
    rows = json_elements(responses(landing, "ashby", "board"), "jobs", ASHBY_JOB, retain_raw)
    rows = rows.filter(listed(F.col("j.isListed")))
    c = F.col
    # an element is a place name or an object that holds one
    place = lambda s: blank_to_null(
        F.when(s.startswith("{"), F.get_json_object(s, "$.location")).otherwise(s))
    summary = F.coalesce(blank_to_null(c("j.compensation.compensationTierSummary")),
                         blank_to_null(c("j.compensation.scrapeableCompensationSalarySummary")))
    period = F.coalesce(c("j.compensation.period"), F.lit("year"))
    pay_range = rules.salary_range(c("j.compensation.min"), c("j.compensation.max"), period)
    ranged = summary.isNull() & pay_range.isNotNull()
    dates = [c(f"j.{n}") for n in ("publishedAt", "createdAt", "updatedAt")]
    places = F.concat(F.array(blank_to_null(c("j.location"))),
                      F.coalesce(F.transform(c("j.secondaryLocations"), place), F.array().cast("array<string>")))
    return finish(rows.withColumns({
        "source_job_id": c("j.id"),
        "company_name": c("company_id"),
        "title": F.coalesce(c("j.title"), F.lit("")),
        "location": first_text(F.array_join(F.array_compact(places), ", "), F.lit(NO_PLACE)),
        "description_text": first_text(c("j.descriptionPlain"), clean_html(c("j.descriptionHtml"))),
        "department": first_text(c("j.department")),
        "team": first_text(c("j.team")),
        "employment_type": rules.ashby_employment(c("j.employmentType")),
        "remote_status": rules.ashby_remote(c("j.workplaceType"), c("j.isRemote")),
        "workplace_type": first_text(c("j.workplaceType")),
        "date_posted": parse_iso(*dates),
        "date_posted_raw": F.coalesce(*[F.when(parse_iso(d).isNotNull(), d) for d in dates]),
        "apply_url": first_text(c("j.applyUrl"), c("j.jobUrl")),
        "source_url": first_text(c("j.jobUrl"), c("j.applyUrl")),
        "salary_text": F.coalesce(summary, pay_range, F.lit("")),
        "salary_min": F.when(ranged, c("j.compensation.min").try_cast("double")),
        "salary_max": F.when(ranged, c("j.compensation.max").try_cast("double")),
        "salary_currency": F.when(ranged, F.coalesce(c("j.compensation.currency"), F.lit("USD"))).otherwise(F.lit("USD")),
        "salary_period": F.when(ranged, period).otherwise(F.lit("year")),
        "reject_reason": missing_id(c("j.id")),
    }))
