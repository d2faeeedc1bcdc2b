"""Ordered word rules: employment type, remote status, places and salaries."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_text, strip

STATUSES = ("new", "changed", "unchanged", "expired", "reopened", "source_error")
REMOTE_STATUSES = ("on_site", "remote", "hybrid", "unknown")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "temporary", "apprenticeship", "unknown")
SOURCE_TYPES = ("greenhouse", "lever", "ashby", "jsonld", "workday")

# --- fixed values: (words, result), tried in order; any word of a rule decides -
_LEVER_EMPLOYMENT = (
    (("full time",), "full_time"),
    (("part time",), "part_time"),
    (("contract", "temporary"), "contract"),
    (("intern", "apprentice"), "apprenticeship"),
)
_ASHBY_EMPLOYMENT = (
    (("fulltime", "full time"), "full_time"),
    (("parttime", "part time"), "part_time"),
    (("contract",), "contract"),
    (("temporary",), "temporary"),
    (("intern", "apprentice"), "apprenticeship"),
)
_JSONLD_EMPLOYMENT = (
    (("part",), "part_time"),
    (("contract",), "contract"),
    (("temporary",), "temporary"),
)
_WORKDAY_EMPLOYMENT = (
    (("part time",), "part_time"),
    (("full time",), "full_time"),
    (("contract",), "contract"),
    (("temporary", "seasonal"), "temporary"),
)
_LEVER_REMOTE = (
    (("remote",), "remote"),
    (("hybrid",), "hybrid"),
    (("office", "onsite", "on-site"), "on_site"),
)
_ASHBY_REMOTE = (
    (("hybrid",), "hybrid"),
    (("remote",), "remote"),
    (("onsite", "on site"), "on_site"),
)
_JSONLD_REMOTE = (
    (("remote", "telecommute"), "remote"),
    (("hybrid",), "hybrid"),
    (("on site",), "on_site"),
)
_WORKDAY_REMOTE = (
    (("hybrid",), "hybrid"),
    (("remote", "work from home"), "remote"),
)
_HOME_COUNTRIES = ("US", "USA", "UNITED STATES")
_REQUISITION_IN_PATH = r"_([A-Za-z]{1,5}[-_]?\d[\w-]*)$"
_PLACE_IN_PATH = r"^/job/([^/]+)/"
_SEVERAL_PLACES = r"(?i)^\d+\s+locations?$"
_TENANT_URL = (
    r"(?i)^https?://([a-z0-9\-]+)\.(wd\d+)\.myworkdayjobs\.com/"
    r"(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_\-]+)"
)
DEFAULT_TENANT_HOST = "wd1"
# -------------------------------------------------------------------------------


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def first_match(text: Column, rules: tuple, default: str | Column = "unknown") -> Column:
    """Result of the first rule that has a word in ``text``."""
    chain = F.when(any_word(text, rules[0][0]), F.lit(rules[0][1]))
    for words, result in rules[1:]:
        chain = chain.when(any_word(text, words), F.lit(result))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def lever_employment(commitment: Column) -> Column:
    return first_match(F.replace(_lower(commitment), F.lit("-"), F.lit(" ")), _LEVER_EMPLOYMENT)


def ashby_employment(value: Column) -> Column:
    return first_match(_lower(value), _ASHBY_EMPLOYMENT)


def jsonld_employment(value: Column) -> Column:
    return first_match(_lower(value), _JSONLD_EMPLOYMENT, "full_time")


def workday_employment(time_type: Column, title: Column) -> Column:
    """An apprenticeship title wins over the time type."""
    by_time = first_match(F.replace(_lower(time_type), F.lit("-"), F.lit(" ")), _WORKDAY_EMPLOYMENT)
    return F.when(_lower(title).contains("apprentice"), F.lit("apprenticeship")).otherwise(by_time)


def greenhouse_remote(title: Column, description: Column) -> Column:
    remote = _lower(title).contains("remote") | _lower(description).contains("work from home")
    return F.when(remote, F.lit("remote")).otherwise(F.lit("unknown"))


def lever_remote(workplace: Column) -> Column:
    return first_match(_lower(workplace), _LEVER_REMOTE)


def ashby_remote(workplace: Column, is_remote: Column) -> Column:
    flag = F.when(F.coalesce(is_remote, F.lit(False)), F.lit("remote")).otherwise(F.lit("unknown"))
    return first_match(_lower(workplace), _ASHBY_REMOTE, flag)


def jsonld_remote(location_type: Column) -> Column:
    return first_match(F.translate(_lower(location_type), "_-", "  "), _JSONLD_REMOTE)


def workday_remote(location: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(title, F.lit(""))))
    return first_match(text, _WORKDAY_REMOTE)


def format_address(locality: Column, region: Column, country: Column) -> Column:
    """``City, Region[, Country]``; the home country is left out."""
    foreign = F.when(~F.upper(country).isin(*_HOME_COUNTRIES), country)
    parts = [F.nullif(c, F.lit("")) for c in (locality, region, foreign)]
    return F.concat_ws(", ", *parts)


def group_thousands(number: Column) -> Column:
    """A number as text, with a comma after every third integer digit."""
    whole = F.substring_index(number, ".", 1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.concat(grouped, F.substring(number, F.length(whole) + 1, F.length(number)))


def salary_range(low: Column, high: Column, unit: Column) -> Column:
    """``$low - $high unit`` from numbers given as text; null unless both count."""
    usable = (low.try_cast("double") != 0) & (high.try_cast("double") != 0)
    text = F.concat(F.lit("$"), group_thousands(low), F.lit(" - $"), group_thousands(high),
                    F.lit(" "), unit)
    return F.when(usable, text)


def requisition_id(path: Column, detail_id: Column | None = None) -> Column:
    """Identity from the path alone; the detail's id only when there is no path."""
    found = F.regexp_extract(path, _REQUISITION_IN_PATH, 1)
    fallback = [] if detail_id is None else [detail_id]
    return first_text(found, path, *fallback)


def place_from_path(path: Column) -> Column:
    return strip(F.replace(F.regexp_extract(F.coalesce(path, F.lit("")), _PLACE_IN_PATH, 1), F.lit("-"), F.lit(" ")))


def summary_location(path: Column, text: Column) -> Column:
    """Place known from the summary; ``3 Locations`` is recovered from the path."""
    given = F.coalesce(text, F.lit(""))
    vague = (given == "") | strip(given).rlike(_SEVERAL_PLACES)
    return F.when(vague, first_text(place_from_path(path), given, F.lit("Unknown"))).otherwise(given)


def tenant_coordinates(tenant: Column, host: Column, site: Column, site_url: Column) -> Column:
    """Struct (tenant, host, site): given fields first, then those in the URL."""
    known = (F.coalesce(tenant, F.lit("")) != "") & (F.coalesce(site, F.lit("")) != "")
    url = F.when(~known, F.coalesce(site_url, F.lit(""))).otherwise(F.lit(""))

    def pick(given: Column, group: int, default: str | None = None) -> Column:
        parsed = F.nullif(F.regexp_extract(url, _TENANT_URL, group), F.lit(""))
        value = F.coalesce(F.nullif(given, F.lit("")), parsed)
        return value if default is None else F.coalesce(value, F.lit(default))

    return F.struct(pick(tenant, 1).alias("tenant"),
                    pick(host, 2, DEFAULT_TENANT_HOST).alias("host"),
                    pick(site, 3).alias("site"))
