"""Which platform serves a careers page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.jsonld import has_posting

# --- fixed values: address patterns and confidences --------------------------------
_GREENHOUSE_URL = r"boards\.greenhouse\.io/([^/]+)"
_GREENHOUSE_TOKEN = r"""board_token['"]?\s*[:=]\s*['"]([^'"]+)['"]"""
_GREENHOUSE_LINK = r"""boards\.greenhouse\.io/([^/"']+)"""
_LEVER_URL = r"jobs\.lever\.co/([^/]+)"
_LEVER_LINK = r"""\blever\.co/([^/"']+)"""
_ASHBY_URL = r"ashby\.co/([^/]+)"
_ASHBY_LINK = r"""ashby\.co/([^/"']+)"""
_ASHBY_HOSTS = ("jobs.ashby.co", "careers.ashby.co")
_WORKDAY_HOST = "myworkdayjobs.com"
# ------------------------------------------------------------------------------------


def _hit(test: Column, kind: str, identifier: Column, confidence: float, *evidence: str) -> Column:
    value = F.struct(
        F.lit(kind).alias("source_type"), identifier.alias("identifier"),
        F.lit(confidence).alias("confidence"), F.array(*[F.lit(e) for e in evidence]).alias("evidence"),
    )
    return F.when(test, value)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _by(text: Column, pattern: str, kind: str, confidence: float, *evidence: str, only: Column | None = None) -> Column:
    name = _found(text, pattern)
    test = name.isNotNull() if only is None else only & name.isNotNull()
    return _hit(test, kind, name, confidence, *evidence)


def classify_page(url: Column, final_url: Column, html: Column, http_status: Column) -> Column:
    """Struct (source_type, identifier, confidence, evidence) of the first test
    that hits; null when the page was not served."""
    final_url, html = F.coalesce(final_url, url), F.coalesce(html, F.lit(""))
    ashby_host = lambda c: c.contains(_ASHBY_HOSTS[0]) | c.contains(_ASHBY_HOSTS[1])
    greenhouse = html.contains("Powered by Greenhouse") | html.contains("greenhouse.io")
    lever = html.contains("lever.co") | (html.contains("Lever") & html.contains("job"))
    cascade = F.coalesce(
        _by(final_url, _GREENHOUSE_URL, "greenhouse", 0.95, "redirected to a Greenhouse board"),
        _by(url, _GREENHOUSE_URL, "greenhouse", 0.95, "address of a Greenhouse board"),
        _by(html, _GREENHOUSE_TOKEN, "greenhouse", 0.85, "page names Greenhouse", only=greenhouse),
        _by(html, _GREENHOUSE_LINK, "greenhouse", 0.75, "page names Greenhouse", "page links a board", only=greenhouse),
        _by(final_url, _LEVER_URL, "lever", 0.95, "redirected to a Lever board"),
        _by(url, _LEVER_URL, "lever", 0.95, "address of a Lever board"),
        _by(html, _LEVER_LINK, "lever", 0.8, "page names Lever", only=lever),
        _by(final_url, _ASHBY_URL, "ashby", 0.95, "redirected to an Ashby board", only=ashby_host(final_url)),
        _by(url, _ASHBY_URL, "ashby", 0.95, "address of an Ashby board", only=ashby_host(url)),
        _by(html, _ASHBY_LINK, "ashby", 0.8, "page links an Ashby board"),
        _hit(final_url.contains(_WORKDAY_HOST), "workday", final_url, 0.5,
             "address of a Workday site"),
        _hit(has_posting(html), "jsonld", url, 0.9, "page embeds a posting"),
        _hit(http_status == 200, "jsonld", url, 0.3,
             "page was served, platform unknown"),
    )
    return F.when(http_status.between(200, 299), cascade)


def classify_pages(pages: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """``pages`` has ``id, url, final_url, http_status, html``. Map-only."""
    found = classify_page(F.col("url"), F.col("final_url"), F.col("html"), F.col("http_status"))
    return pages.select("id", "url", found.alias("found")).select(
        "id", "url", F.when(F.col("found.confidence") >= min_confidence, F.col("found")).alias("found"))


def probe_outcome(landing: DataFrame) -> DataFrame:
    """Whether the stored probe response of a source is usable and holds postings."""
    body = F.col("body")
    size = lambda schema, field: F.size(F.from_json(body, schema)[field])
    holds = (
        F.when(F.col("source_type").isin("greenhouse", "ashby"), size("struct<jobs: array<string>>", "jobs") > 0)
        .when(F.col("source_type") == "lever",
              F.ltrim(body).startswith("[") & (F.size(F.from_json(body, "array<string>")) > 0))
        .when(F.col("source_type") == "workday", size("struct<jobPostings: array<string>>", "jobPostings") > 0)
        .when(F.col("source_type") == "jsonld", has_posting(body))
    )
    usable = (F.col("http_status") == 200) & F.col("error").isNull() & holds
    return landing.groupBy("company_id", "source_type").agg(
        F.max(F.coalesce(usable, F.lit(False))).alias("accessible"))


def discovery_report(companies: DataFrame, classified: DataFrame, probes: DataFrame) -> DataFrame:
    """Outcome per company: no_url, detection_failed, success or no_access.

    ``classified`` is keyed by ``url``; ``probes`` by company and source type.
    """
    seen = classified.select(F.col("url").alias("career_page_url"), "found").filter("found is not null")
    joined = companies.select("id", "name", "career_page_url").join(seen, "career_page_url", "left")
    typed = joined.withColumn("source_type", F.col("found.source_type")).join(
        probes.select(F.col("company_id").alias("id"), "source_type", "accessible"), ["id", "source_type"], "left")
    ok = F.coalesce(F.col("accessible"), F.lit(False))
    result = (
        F.when(F.coalesce(F.col("career_page_url"), F.lit("")) == "", F.lit("no_url"))
        .when(F.col("found").isNull(), F.lit("detection_failed"))
        .when(ok, F.lit("success")).otherwise(F.lit("no_access"))
    )
    by_url = F.col("source_type").isin("jsonld", "workday")
    return typed.select(
        "id", "name", "career_page_url", result.alias("discovery_result"), "source_type",
        F.when(~by_url, F.col("found.identifier")).alias("board"),
        F.when(by_url, F.col("found.identifier")).alias("site_url"),
        F.col("found.confidence").alias("confidence"),
        F.when(F.col("found").isNotNull(), ok).alias("enabled"),
    )
