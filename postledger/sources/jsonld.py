"""Decoder of schema.org postings embedded in web pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import parse_iso
from ..functions.text import blank_to_null, content_hash, first_text, uuid5_url
from .landing import finish, option_is_on, responses

# --- fixed values -------------------------------------------------------------------
_BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_POSTING_TYPE = "JobPosting"
_NO_PLACE = "Remote"
# ------------------------------------------------------------------------------------


def _get(v: Column, path: str, type_name: str = "string") -> Column:
    return F.try_variant_get(v, path, type_name)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant holds an OBJECT or an ARRAY."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _plain(v: Column, path: str) -> Column:
    """Text of a scalar field; null for objects and arrays."""
    part = _get(v, path, "variant")
    return F.when(~_is(part, "OBJECT") & ~_is(part, "ARRAY"), _get(v, path))


def jsonld_blocks(pages: DataFrame, html: str = "body") -> DataFrame:
    """Parsed script blocks of each page; blocks that do not parse are skipped."""
    found = F.regexp_extract_all(F.col(html), F.lit(_BLOCK), F.lit(1))
    numbered = F.transform(found, lambda text, i: F.struct(i.alias("block_no"), F.try_parse_json(text).alias("block")))
    parsed = F.filter(numbered, lambda b: b["block"].isNotNull())
    cols = [c for c in pages.columns if c != html]
    # outer, so that no second pass over the page is made for a size filter
    exploded = pages.select(*cols, F.explode_outer(parsed).alias("b")).filter(F.col("b").isNotNull())
    return exploded.select(*cols, "b.block_no", "b.block")


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """Posting items of a block: a graph, a list or a single object."""
    block = F.col("block")
    graph = _get(block, '$["@graph"]', "variant")
    items = (
        F.when(_is(block, "OBJECT") & graph.isNotNull(), _get(graph, "$", "array<variant>"))
        .when(_is(block, "ARRAY"), _get(block, "$", "array<variant>"))
        .when(_is(block, "OBJECT"), F.array(block))
    )
    cols = [c for c in blocks.columns if c != "block"]
    return (
        blocks.select(*cols, F.posexplode_outer(items).alias("item_no", "item"))
        .filter(is_posting(F.col("item")))
    )


def is_posting(item: Column) -> Column:
    kind = _get(item, '$["@type"]', "variant")
    listed = F.array_contains(_get(kind, "$", "array<string>"), _POSTING_TYPE)
    named = _get(item, '$["@type"]').contains(_POSTING_TYPE)
    return F.coalesce(F.when(_is(kind, "ARRAY"), listed).otherwise(named), F.lit(False))


def has_posting(html: Column) -> Column:
    """Whether a page embeds at least one posting (no rows are made)."""
    def in_block(text: Column) -> Column:
        block = F.try_parse_json(text)
        graph = _get(block, '$["@graph"]', "array<variant>")
        listed = _get(block, "$", "array<variant>")
        items = F.coalesce(graph, listed, F.array(block))
        return F.coalesce(F.exists(items, is_posting), F.lit(False))

    return F.coalesce(F.exists(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1)), in_block), F.lit(False))


def _address(item: Column) -> Column:
    place = F.coalesce(_get(item, "$.jobLocation[0]", "variant"), _get(item, "$.jobLocation", "variant"))
    country = F.coalesce(_get(place, "$.address.addressCountry.name"), _plain(place, "$.address.addressCountry"))
    parts = rules.format_address(_get(place, "$.address.addressLocality"),
                                 _get(place, "$.address.addressRegion"), country)
    return F.when(_is(_get(place, "$.address", "variant"), "OBJECT"), parts).otherwise(_plain(place, "$.address"))


def jsonld_rows(landing: DataFrame, retain_raw: bool = False) -> DataFrame:
    """Postings of the landed pages. An item without a title is not a posting."""
    pages = responses(landing, "jsonld", "html").select(
        "run_id", "fetched_at", "company_id", "source_type", "source_key", "options", "body")
    rows = expand_blocks(jsonld_blocks(pages))
    item = F.col("item")
    title = _get(item, "$.title")
    rows = rows.filter(F.coalesce(title, F.lit("")) != "")
    url = F.coalesce(_get(item, "$.url"), F.lit(""))
    organisation = F.coalesce(_get(item, "$.hiringOrganization.name"), blank_to_null(_plain(item, "$.hiringOrganization")))
    # the id may be given as text, as an object with a value, or in another shape
    identifier = F.coalesce(_plain(item, "$.identifier"), _get(item, "$.identifier.value"), _get(item, "$.identifier"))
    where = _get(item, "$.applicantLocationRequirements")
    low, high = _get(item, "$.baseSalary.minValue"), _get(item, "$.baseSalary.maxValue")
    currency = F.coalesce(_get(item, "$.baseSalary.currency"), F.lit("USD"))
    kind = _get(item, "$.employmentType", "variant")
    text = rows.withColumns({
        "pos": F.col("block_no").cast("long") * (1 << 20) + F.col("item_no"),
        "company_name": F.coalesce(organisation, F.col("company_id")),
        "title": title,
        "location": first_text(_address(item), F.lit(_NO_PLACE)),
        "description_text": first_text(_get(item, "$.description"), _get(item, "$.jobDescription")),
        "employment_type": rules.jsonld_employment(_get(item, "$.employmentType")),
        "remote_status": rules.jsonld_remote(_get(item, "$.jobLocationType")),
        # used only when it is an address; the field normally describes places
        "apply_url": F.when(where.rlike("^https?://"), where).otherwise(url),
        "source_url": url,
        "salary_text": F.coalesce(rules.salary_range(low, high, currency), F.lit("")),
        "salary_min": low.try_cast("double"),
        "salary_max": high.try_cast("double"),
        "salary_currency": currency,
        "date_posted": parse_iso(_get(item, "$.datePosted")),
        "date_posted_raw": _get(item, "$.datePosted"),
        "raw": F.when(option_is_on("store_raw"), F.to_json(item)) if retain_raw else F.lit(None).cast("string"),
        "reject_reason": F.when(_is(kind, "ARRAY"), F.lit("employmentType is a list")),
    })
    own = content_hash(F.col("company_name"), F.col("title"), F.col("location"),
                       F.col("description_text"), F.col("apply_url"))
    made = F.when(url != "", uuid5_url(url)).otherwise(own)
    return finish(text.withColumn("source_job_id", first_text(identifier, made)))
