"""Queries on payload decoders. Payloads are made from the given tables by Spark,
one stored response per document, in the shape each platform sends."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import LocationFilter
from ..operators import rollups as R
from ..operators import validate as V
from ..sources import boards, jsonld, union, workday
from ..session import cut_lineage, shared_folder
from ..sources import landing as landed
from ..sources.landing import accepted, rejected, unreadable_responses
from .registry import SQL, query
from .views import SQL_POST, posting_base



class _DocId:
    """``doc_id`` as a column, made when used (columns need a session)."""

    def __mod__(self, n: int) -> Column:
        return F.col("doc_id") % n


_KEY = _DocId()
_SITE = "https://acme.wd5.myworkdayjobs.com/en-US/Careers"


def _landing(base: DataFrame, source_type: str, kind: str, body: Column, **cols: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    bad = _KEY % 23 == 4  # some responses failed
    values = {
        "run_id": F.lit("r1"), "fetched_at": F.lit("2024-03-10 12:00:00").cast("timestamp_ntz"),
        "company_id": F.col("source_company_id"), "source_type": F.lit(source_type), "source_key": F.lit(_SITE),
        "page_kind": F.lit(kind), "page_seq": F.lit(0), "search_term": null, "term_ord": F.lit(0), "request_path": null,
        "final_url": null, "http_status": F.when(bad, F.lit(503)).otherwise(F.lit(200)), "error": null,
        "options": F.create_map(F.lit("store_raw"), F.lit("true")), "body": body, **cols,
    }
    return base.select(*[c.alias(n) for n, c in values.items()])


def _when(test: Column, value: Column | str) -> Column:
    return F.when(test, F.lit(value) if isinstance(value, str) else value)


def greenhouse_landing(spark, sf, base: DataFrame | None = None):
    b = posting_base(spark, sf) if base is None else base
    three = _KEY % 3
    office = lambda name, place: F.struct(name.alias("name"), place.alias("location"))
    null = F.lit(None).cast("string")
    job = F.struct(
        _when(_KEY % 17 != 5, F.col("doc_id")).alias("id"),
        F.when(_KEY % 6 == 1, F.concat(F.lit("Remote "), "title")).otherwise(F.col("title")).alias("title"),
        _when(_KEY % 2 == 0, F.struct(F.upper("company_name").alias("name"))).alias("company"),
        _when(three == 0, F.struct(F.col("location").alias("name"))).alias("location"),
        _when(three == 1, F.array(office(F.lit("Tower"), F.col("location")), office(F.lit("HQ"), null))).alias("offices"),
        F.array(F.struct(F.col("category").alias("name")), F.struct(F.lit("Staff").alias("name"))).alias("departments"),
        _when(_KEY % 4 == 0, "some day").alias("published_at"),
        F.concat(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("T22:30:00-05:00")).alias("updated_at"),
        F.concat(F.lit("&lt;p&gt;"), "description_text", F.lit("&lt;/p&gt;")).alias("content"),
        F.col("apply_url").alias("absolute_url"),
    )
    return _landing(b, "greenhouse", "board", F.to_json(F.struct(F.array(job).alias("jobs"))))


_GOOD = "doc_id % 23 <> 4"
_LINES = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
_CLEAN = _LINES.format("regexp_replace('<p>' || description_text || '</p>', '<[^>]+>', chr(10), 'g')")
_GH_SQL = f"""
  g AS (SELECT doc_id, source_company_id || '#greenhouse' AS source_id, source_job_id,
    CASE WHEN doc_id % 2 = 0 THEN upper(company_name) ELSE source_company_id END AS company_name,
    CASE WHEN doc_id % 6 = 1 THEN 'Remote ' || title ELSE title END AS title,
    CASE doc_id % 3 WHEN 0 THEN location WHEN 1 THEN location || ', HQ' ELSE 'Remote' END AS location,
    CASE WHEN category <> '' THEN category || ', Staff' ELSE 'Staff' END AS department, {_CLEAN} AS description_text,
    'full_time' AS employment_type, CASE WHEN doc_id % 6 = 1 THEN 'remote' ELSE 'unknown' END AS remote_status,
    strftime(date_posted, '%Y-%m-%d') || ' 22:30:00' AS posted, apply_url FROM v_post WHERE {_GOOD})"""
_OUT = "company_name, title, location, employment_type, remote_status, posted, apply_url"
_DIGEST = "sha256(company_name || '|' || title || '|' || location || '|' || description_text || '|' || apply_url) AS content_hash"


def _shown(decoded: DataFrame, *extra: str) -> DataFrame:
    return accepted(decoded).select(
        "source_id", "source_job_id", "company_name", "title", "location", "employment_type", "remote_status",
        F.date_format("date_posted", "yyyy-MM-dd HH:mm:ss").alias("posted"), "apply_url", "content_hash", *extra)


@query("decode_greenhouse", SQL_POST + f",{_GH_SQL} SELECT source_id, source_job_id, {_OUT}, {_DIGEST}, department FROM g WHERE doc_id % 17 <> 5")
def decode_greenhouse(spark, sf):
    return _shown(boards.greenhouse_rows(greenhouse_landing(spark, sf)), "department")


@query("quarantine", SQL_POST + f",{_GH_SQL} SELECT source_id, title, 'missing id' AS reject_reason FROM g WHERE doc_id % 17 = 5")
def quarantine(spark, sf):
    return rejected(boards.greenhouse_rows(greenhouse_landing(spark, sf))).select("source_id", "title", "reject_reason")


@query("retained_payloads", SQL_POST + f" SELECT source_job_id, title AS raw_title FROM v_post WHERE {_GOOD} AND doc_id % 29 <> 3")
def retained_payloads(spark, sf):
    out = accepted(boards.lever_rows(lever_landing(spark, sf), retain_raw=True))
    return out.select("source_job_id", F.get_json_object("raw_payload", "$.text").alias("raw_title"))


def lever_landing(spark, sf, base: DataFrame | None = None):
    b = posting_base(spark, sf) if base is None else base
    commitment = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract' WHEN 3 THEN 'Internship' END")
    cats = F.struct(
        commitment.alias("commitment"), F.col("category").alias("department"), _when(_KEY % 3 == 0, F.col("location")).alias("location"),
        _when(_KEY % 3 == 1, F.array("location", F.lit("Anywhere"))).alias("allLocations"), F.lit("Team A").alias("team"))
    millis = F.unix_millis(F.col("date_posted").cast("timestamp"))
    job = F.struct(
        F.col("source_job_id").alias("id"), F.col("title").alias("text"), cats.alias("categories"), millis.cast("string").alias("createdAt"),
        F.col("source_url").alias("hostedUrl"), _when(_KEY % 2 == 0, F.col("apply_url")).alias("applyUrl"),
        _when(_KEY % 4 != 0, F.col("description_text")).alias("descriptionPlain"),
        F.concat(F.lit("<div>"), "description_text", F.lit("</div>")).alias("description"),
        _when(_KEY % 5 == 0, " Benefits ").alias("additionalPlain"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'onsite' END").alias("workplaceType"))
    body = F.when(_KEY % 29 == 3, F.lit('{"data": [{"id": "x"}]}')).otherwise(F.to_json(F.array(job)))
    return _landing(b, "lever", "board", body)


_LEVER_SQL = f"""
  l AS (SELECT doc_id, source_company_id || '#lever' AS source_id, source_job_id, source_company_id AS company_name, title,
    CASE doc_id % 3 WHEN 0 THEN location WHEN 1 THEN location || ', Anywhere' ELSE 'Remote' END AS location,
    CASE doc_id % 5 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'apprenticeship' ELSE 'unknown' END AS employment_type,
    CASE doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'on_site' ELSE 'unknown' END AS remote_status,
    strftime(date_posted, '%Y-%m-%d %H:%M:%S') AS posted, CASE WHEN doc_id % 2 = 0 THEN apply_url ELSE source_url END AS apply_url,
    CASE WHEN doc_id % 4 <> 0 THEN description_text ELSE {_LINES.format("regexp_replace('<div>' || description_text || '</div>', '<[^>]+>', chr(10), 'g')")} END AS main
    FROM v_post WHERE {_GOOD} AND doc_id % 29 <> 3),
  l2 AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(main || chr(10) || chr(10) || ' Benefits ', '^\\s+|\\s+$', '', 'g') ELSE main END AS description_text FROM l)"""


@query("decode_lever", SQL_POST + f",{_LEVER_SQL} SELECT source_id, source_job_id, {_OUT}, {_DIGEST} FROM l2")
def decode_lever(spark, sf):
    return _shown(boards.lever_rows(lever_landing(spark, sf)))


def ashby_landing(spark, sf, base: DataFrame | None = None):
    b = posting_base(spark, sf) if base is None else base
    secondary = F.when(_KEY % 3 == 0, F.array(F.struct(F.lit("Dallas").alias("location")), F.struct(F.lit("").alias("location"))))
    comp = F.struct(_when(_KEY % 4 == 0, "$100K - $120K").alias("compensationTierSummary"),
                    _when(_KEY % 4 == 1, (_KEY % 100 + 100) * 1000).alias("min"), (_KEY % 100 + 150).alias("max"),
                    _when(_KEY % 8 == 1, "EUR").alias("currency"), F.lit("month").alias("period"))
    job = F.struct(
        F.col("source_job_id").alias("id"), F.col("title").alias("title"), _when(_KEY % 5 != 2, F.col("location")).alias("location"),
        secondary.alias("secondaryLocations"), F.expr("CASE doc_id % 5 WHEN 0 THEN 'FullTime' WHEN 1 THEN 'Intern' WHEN 2 THEN 'Temporary' END").alias("employmentType"),
        F.concat(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("T01:02:03.456+00:00")).alias("publishedAt"),
        F.col("source_url").alias("jobUrl"), F.col("apply_url").alias("applyUrl"), F.col("description_text").alias("descriptionPlain"),
        (_KEY % 3 == 1).alias("isRemote"), _when(_KEY % 7 != 0, _KEY % 7 != 3).alias("isListed"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'OnSite' END").alias("workplaceType"), comp.alias("compensation"))
    return _landing(b, "ashby", "board", F.to_json(F.struct(F.array(job).alias("jobs"))))


@query("decode_ashby", SQL_POST + f""", a AS (SELECT doc_id, source_company_id || '#ashby' AS source_id, source_job_id, source_company_id AS company_name, title, description_text, apply_url,
    CASE WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'Dallas' ELSE 'Remote' END ELSE location || CASE WHEN doc_id % 3 = 0 THEN ', Dallas' ELSE '' END END AS location,
    CASE doc_id % 5 WHEN 0 THEN 'full_time' WHEN 1 THEN 'apprenticeship' WHEN 2 THEN 'temporary' ELSE 'unknown' END AS employment_type,
    CASE WHEN doc_id % 4 = 0 THEN 'hybrid' WHEN doc_id % 4 = 1 THEN 'on_site' WHEN doc_id % 3 = 1 THEN 'remote' ELSE 'unknown' END AS remote_status,
    strftime(date_posted, '%Y-%m-%d') || ' 01:02:03' AS posted,
    CASE doc_id % 4 WHEN 0 THEN '$100K - $120K' WHEN 1 THEN '$' || format('{{:,}}', (doc_id % 100 + 100) * 1000) || ' - $' || (doc_id % 100 + 150) || ' month' ELSE '' END AS salary_text,
    CASE WHEN doc_id % 8 = 1 THEN 'EUR' ELSE 'USD' END AS salary_currency, CASE WHEN doc_id % 4 = 1 THEN 'month' ELSE 'year' END AS salary_period
  FROM v_post WHERE {_GOOD} AND doc_id % 7 <> 3)
  SELECT source_id, source_job_id, {_OUT}, {_DIGEST}, salary_text, salary_currency, salary_period FROM a""")
def decode_ashby(spark, sf):
    return _shown(boards.ashby_rows(ashby_landing(spark, sf)), "salary_text", "salary_currency", "salary_period")


# --- workday: two search terms over the same postings, details for some ----------------------
_AREA = LocationFilter(include=("AFRICA", "Oslo"), exclude=("NATION_5",))


def workday_landing(spark, sf, base: DataFrame | None = None):
    b = posting_base(spark, sf) if base is None else base
    path = F.concat(F.lit("/job/Oslo/Job"), F.when(_KEY % 3 == 0, F.concat(F.lit("_JR"), F.col("source_job_id"))).otherwise(F.concat(F.lit("-"), F.col("source_job_id"))))
    summary = F.struct(
        F.col("title").alias("title"), path.alias("externalPath"), F.lit("Full time").alias("timeType"),
        F.when(_KEY % 4 == 0, F.lit("3 Locations")).otherwise(F.col("location")).alias("locationsText"),
        F.concat(F.lit("Posted "), (_KEY % 9).cast("string"), F.lit(" Days Ago")).alias("postedOn"))
    page = lambda s: F.to_json(F.struct(F.lit(2).alias("total"), F.array(s).alias("jobPostings")))
    first = _landing(b, "workday", "search", page(summary), search_term=F.lit("a"))
    again = summary.withField("title", F.lit("seen in the second search"))
    second = _landing(b, "workday", "search", page(again), search_term=F.lit("b"), term_ord=F.lit(1))
    info = F.struct(F.concat(F.lit("Detail "), "title").alias("title"), F.concat(F.lit("<p>"), "description_text", F.lit("</p>")).alias("jobDescription"),
                    _when(_KEY % 4 == 1, F.date_format("date_posted", "yyyy-MM-dd")).alias("startDate"), F.lit("Part time").alias("timeType"))
    detail = _landing(b.filter("doc_id % 2 = 1"), "workday", "detail", F.to_json(F.struct(info.alias("jobPostingInfo"))), request_path=path)
    return first.unionByName(second).unionByName(detail)


_PATH = "'/job/Oslo/Job' || CASE WHEN doc_id % 3 = 0 THEN '_JR' ELSE '-' END || source_job_id"
_PLACE = "CASE WHEN doc_id % 4 = 0 THEN 'Oslo' ELSE location END"
_IN_AREA = rf"(regexp_matches({_PLACE}, '(?i)\bAFRICA\b|\bOslo\b') AND NOT regexp_matches({_PLACE}, '(?i)\bNATION_5\b'))"


@query("decode_workday", SQL_POST + f""", w AS (SELECT doc_id, source_company_id || '#workday' AS source_id, source_company_id AS company_name,
    CASE WHEN doc_id % 3 = 0 THEN 'JR' || source_job_id ELSE {_PATH} END AS source_job_id,
    CASE WHEN doc_id % 2 = 1 THEN 'Detail ' || title ELSE title END AS title, {_PLACE} AS location,
    CASE WHEN doc_id % 2 = 1 THEN 'part_time' ELSE 'full_time' END AS employment_type, 'unknown' AS remote_status,
    CASE WHEN doc_id % 4 = 1 THEN strftime(date_posted, '%Y-%m-%d') || ' 00:00:00'
      ELSE strftime(TIMESTAMP '2024-03-10 12:00:00' - to_days(CAST(doc_id % 9 AS INT)), '%Y-%m-%d %H:%M:%S') END AS posted,
    CASE WHEN doc_id % 2 = 1 THEN {_CLEAN} ELSE '' END AS description_text,
    'https://acme.wd5.myworkdayjobs.com/Careers' || {_PATH} AS apply_url FROM v_post WHERE {_GOOD})
  SELECT source_id, source_job_id, {_OUT}, {_DIGEST} FROM w""")
def decode_workday(spark, sf):
    return _shown(workday.workday_rows(workday_landing(spark, sf)))


@query("workday_summaries", SQL_POST + f" SELECT source_company_id AS company_id, {_PATH} AS path, title, {_PLACE} AS location FROM v_post WHERE {_GOOD}")
def workday_summaries(spark, sf):
    return workday.search_summaries(workday_landing(spark, sf)).select("company_id", "path", F.col("summary.title").alias("title"), "location")


@query("workday_completeness", SQL_POST + f""", n AS (SELECT source_company_id AS company_id, count(*) AS n FROM v_post WHERE {_GOOD} GROUP BY 1)
  SELECT company_id, term AS search_term, n AS found, 2 AS total, CASE WHEN n < 2 THEN company_id || ': collected ' || n || ' of 2 postings for search ''' || term || ''' (max_jobs=1000)' END AS warning
  FROM n, (SELECT unnest(['a', 'b']) AS term)""")
def workday_completeness(spark, sf):
    return workday.search_completeness(workday_landing(spark, sf)).select("company_id", "search_term", "found", "total", "warning")


@query("workday_detail_targets", SQL_POST + f""" SELECT company_id, path FROM (SELECT source_company_id AS company_id, {_PATH} AS path,
    row_number() OVER (PARTITION BY source_company_id ORDER BY {_PATH}) AS n FROM v_post WHERE {_GOOD} AND {_IN_AREA}) WHERE n <= 7""")
def workday_detail_targets(spark, sf):
    return workday.detail_targets(workday.search_summaries(workday_landing(spark, sf)), _AREA, 7).select("company_id", "path")


@query("warnings", SQL_POST + f""", n AS (SELECT source_company_id AS company_id, count(*) AS n FROM v_post WHERE {_GOOD} AND {_IN_AREA} GROUP BY 1), {_GH_SQL[3:]}
  SELECT 'detail cap' AS kind, company_id || '#workday' AS subject, company_id || ': fetched descriptions for 7 of ' || n || ' postings (max_detail_fetches=7)' AS warning FROM n WHERE n > 7
  UNION ALL SELECT 'rejected row', source_id, 'missing id' FROM g WHERE doc_id % 17 = 5""")
def warnings(spark, sf):
    landing = workday_landing(spark, sf)
    caps = workday.detail_cap_warnings(workday.search_summaries(landing), _AREA, 7)
    bad = rejected(boards.greenhouse_rows(greenhouse_landing(spark, sf)))
    return V.warnings(workday.search_completeness(landing), caps, bad)


# --- responses whose body cannot be decoded ----------------------------------------------------
def mixed_landing(spark, sf):
    """One response per document: readable, cut off, a page of HTML, another shape, blank, without body or failed."""
    b = posting_base(spark, sf)
    jobs = F.concat(F.lit('[{"id": "'), F.col("doc_id").cast("string"), F.lit('", "title": "'), "title", F.lit('"}]'))
    board = F.concat(F.lit('{"jobs": '), jobs, F.lit("}"))
    flat = F.expr("floor(doc_id / 100) % 5 = 1")
    right, wrong = F.when(flat, jobs).otherwise(board), F.when(flat, board).otherwise(jobs)
    k = _KEY % 8
    body = (F.when(k == 1, F.expr("substring(%s, 1, 20 + doc_id %% 9)" % "concat('{\"jobs\": [{\"id\": \"', doc_id, '\", \"title\": \"', title, '\"}]}')"))
            .when(k == 2, F.lit("<html>busy</html>")).when(k == 3, wrong).when(k == 4, F.lit(" \n"))
            .when(k == 5, F.lit(None).cast("string")).when(k == 6, F.concat(F.lit("\n "), right)).otherwise(right))
    kind = F.when(F.col("source_type") == "workday", F.lit("search")).when(F.col("source_type") == "jsonld", F.lit("html")).otherwise(F.lit("board"))
    rows = _landing(b, "", "", body, page_kind=kind, page_seq=F.col("doc_id").cast("int"), options=F.create_map(F.lit("type"), "source_type"))
    return rows.withColumn("source_type", F.element_at("options", "type"))


_MIXED_SQL = SQL_POST + """, b AS (SELECT *, '[{"id": "' || doc_id || '", "title": "' || title || '"}]' AS jobs, source_type = 'lever' AS flat FROM v_post),
  c AS (SELECT *, '{"jobs": ' || jobs || '}' AS board FROM b),
  m AS (SELECT *, CASE doc_id % 8 WHEN 1 THEN substr(board, 1, CAST(20 + doc_id % 9 AS INT)) WHEN 2 THEN '<html>busy</html>'
      WHEN 3 THEN CASE WHEN flat THEN board ELSE jobs END WHEN 4 THEN ' ' || chr(10) WHEN 5 THEN NULL
      ELSE CASE WHEN flat THEN jobs ELSE board END END AS body FROM c),
  u AS (SELECT doc_id, source_id, CASE WHEN trim(body, ' ' || chr(10)) = '' THEN 'empty body' WHEN NOT json_valid(body) THEN 'body is not JSON'
      WHEN flat AND json_type(body) <> 'ARRAY' THEN 'body is not an array' WHEN NOT flat AND json_type(body) <> 'OBJECT' THEN 'body is not an object' END AS reason
    FROM m WHERE source_type <> 'jsonld' AND body IS NOT NULL AND doc_id % 23 <> 4)"""


@query("unreadable_responses", _MIXED_SQL + " SELECT source_id, CAST(doc_id AS INT) AS page_seq, reason AS reject_reason FROM u WHERE reason IS NOT NULL")
def unreadable_responses_query(spark, sf):
    """Successful responses whose body is cut off, blank, no JSON or another shape than their source publishes."""
    return unreadable_responses(mixed_landing(spark, sf)).select("source_id", "page_seq", "reject_reason")


@query("errors_with_unreadable_responses", _MIXED_SQL + """ SELECT source_id, count(*) AS failed_responses FROM (
    SELECT source_id FROM u WHERE reason IS NOT NULL UNION ALL SELECT source_id FROM m WHERE doc_id % 23 = 4) GROUP BY 1""")
def errors_with_unreadable_responses(spark, sf):
    """Failed responses by source: an unreadable body counts as one, so its source expires nothing."""
    return R.source_errors(mixed_landing(spark, sf)).select("source_id", "failed_responses")


# --- pages with embedded postings ---------------------------------------------------------------
def _item(title: Column) -> Column:
    place = F.struct(F.struct(F.lit("Austin").alias("addressLocality"), F.col("location").alias("addressRegion"),
                              F.when(_KEY % 2 == 0, F.lit("USA")).otherwise(F.lit("DE")).alias("addressCountry")).alias("address"))
    salary = F.struct(((_KEY % 50 + 50) * 1000).alias("minValue"), ((_KEY % 50 + 90) * 1000).alias("maxValue"), _when(_KEY % 2 == 0, "EUR").alias("currency"))
    return F.struct(
        F.lit("JobPosting").alias("@type"), title.alias("title"), F.concat(F.lit("https://jobs.example.com/ld/"), F.col("source_job_id")).alias("url"),
        F.struct(F.col("company_name").alias("name")).alias("hiringOrganization"), F.array(place).alias("jobLocation"),
        F.col("description_text").alias("description"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'PART_TIME' WHEN 1 THEN 'CONTRACTOR' WHEN 2 THEN 'FULL_TIME' END").alias("employmentType"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'TELECOMMUTE' WHEN 1 THEN 'ON_SITE' END").alias("jobLocationType"),
        _when(_KEY % 3 != 0, F.struct(F.concat(F.lit("ref-"), F.col("source_job_id")).alias("value"))).alias("identifier"),
        salary.alias("baseSalary"), F.date_format("date_posted", "yyyy-MM-dd").alias("datePosted"))


def _page_html() -> Column:
    one, other = _item(F.col("title")), F.struct(F.lit("Organization").alias("@type"))
    body = (F.when(_KEY % 4 == 0, F.to_json(F.struct(F.array(one, _item(F.lit(""))).alias("@graph"))))
            .when(_KEY % 4 == 1, F.to_json(F.array(one))).when(_KEY % 4 == 2, F.to_json(one)).otherwise(F.to_json(other)))
    quote = F.when(_KEY % 2 == 0, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(F.lit('<html><SCRIPT type="application/ld+json">{broken</SCRIPT><script id="x" type='), quote, F.lit("application/ld+json"), quote,
                    F.lit(">"), body, F.lit("</script><p>text</p></html>"))


def jsonld_landing(spark, sf, base: DataFrame | None = None):
    return _landing(posting_base(spark, sf) if base is None else base, "jsonld", "html", _page_html())


_LD = f"""
  ld AS (SELECT doc_id, source_company_id || '#jsonld' AS source_id, company_name, title, 'Austin, ' || location || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ', DE' END AS location,
    'https://jobs.example.com/ld/' || source_job_id AS apply_url, description_text, source_job_id AS k,
    CASE doc_id % 4 WHEN 0 THEN 'part_time' WHEN 1 THEN 'contract' ELSE 'full_time' END AS employment_type,
    CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'on_site' ELSE 'unknown' END AS remote_status, strftime(date_posted, '%Y-%m-%d') || ' 00:00:00' AS posted,
    '$' || format('{{:,}}', (doc_id % 50 + 50) * 1000) || ' - $' || format('{{:,}}', (doc_id % 50 + 90) * 1000) || CASE WHEN doc_id % 2 = 0 THEN ' EUR' ELSE ' USD' END AS salary_text
    FROM v_post WHERE {_GOOD} AND doc_id % 4 <> 3),
  ld2 AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(apply_url)) AS d FROM ld)"""


@query("decode_jsonld", SQL_POST + f""",{_LD} SELECT source_id, CASE WHEN doc_id % 3 <> 0 THEN 'ref-' || k ELSE left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
    lower(to_hex((CAST('0x' || substr(d, 17, 2) AS INT) & 63) + 128)) || substr(d, 19, 2) || '-' || substr(d, 21, 12) END AS source_job_id, {_OUT}, {_DIGEST}, salary_text FROM ld2""")
def decode_jsonld(spark, sf):
    return _shown(jsonld.jsonld_rows(jsonld_landing(spark, sf)), "salary_text")


@query("jsonld_blocks", "SELECT doc_id, 1 AS block_no FROM documents")
def jsonld_blocks(spark, sf):
    pages = posting_base(spark, sf).select("doc_id", _page_html().alias("html"))
    return jsonld.jsonld_blocks(pages, "html").select("doc_id", "block_no")


@query("jsonld_items", """SELECT doc_id, 0 AS item_no FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 4 = 0""")
def jsonld_items(spark, sf):
    pages = posting_base(spark, sf).select("doc_id", _page_html().alias("html"))
    return jsonld.expand_blocks(jsonld.jsonld_blocks(pages, "html")).select("doc_id", "item_no")


@query("page_has_posting", "SELECT doc_id, doc_id % 4 <> 3 AS has_posting FROM documents")
def page_has_posting(spark, sf):
    pages = posting_base(spark, sf).select("doc_id", _page_html().alias("html"))
    return pages.select("doc_id", jsonld.has_posting(F.col("html")).alias("has_posting"))


def _rows_of(name: str) -> str:
    """The common table expressions of a decoder's statement."""
    return SQL[name][len(SQL_POST):].rsplit("SELECT source_id, ", 1)[0]


@query("union_sources", SQL_POST + _rows_of("decode_greenhouse") + _rows_of("decode_lever") + _rows_of("decode_ashby") + _rows_of("decode_jsonld")
       + _rows_of("decode_workday") + f""" SELECT source_id, {_DIGEST} FROM g WHERE doc_id % 17 <> 5 UNION ALL SELECT source_id, {_DIGEST} FROM l2 UNION ALL SELECT source_id, {_DIGEST} FROM a
    UNION ALL SELECT source_id, {_DIGEST} FROM ld2 UNION ALL SELECT source_id, {_DIGEST} FROM w WHERE {_IN_AREA.replace(_PLACE, "location")}""")
def union_sources(spark, sf):
    return union.union_sources(_all_landing(spark, sf), where=_AREA).select("source_id", "content_hash")


def _all_landing(spark, sf):
    # seven responses per posting: the texts are read, joined and dealt out to all tasks once, and written for all of them
    base = cut_lineage(posting_base(spark, sf).repartition("doc_id"))
    landing = greenhouse_landing(spark, sf, base)
    for other in (lever_landing, ashby_landing, workday_landing, jsonld_landing):
        landing = landing.unionByName(other(spark, sf, base))
    return landing


@query("read_landing", """SELECT source_type, page_kind, count(*) AS responses FROM (SELECT unnest(['greenhouse/board', 'lever/board', 'ashby/board', 'jsonld/html', 'workday/search', 'workday/search']) AS k FROM documents
    UNION ALL SELECT 'workday/detail' FROM documents WHERE doc_id % 2 = 1), LATERAL (SELECT split_part(k, '/', 1) AS source_type, split_part(k, '/', 2) AS page_kind) GROUP BY ALL""")
def read_landing(spark, sf):
    """Landed responses written by partition and read back for one run."""
    folder = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    _all_landing(spark, sf).write.partitionBy("run_id", "source_type", "page_kind").parquet(folder)
    return landed.read_landing(spark, folder, "r1").groupBy("source_type", "page_kind").agg(F.count("*").alias("responses"))


@query("search_plan", SQL_POST + f""" SELECT DISTINCT source_company_id AS company_id, term AS search_term, 2 AS total, 1 AS pages, 0 AS left_out
  FROM v_post, (SELECT unnest(['a', 'b']) AS term) WHERE {_GOOD}""")
def search_plan(spark, sf):
    return workday.search_plan(workday_landing(spark, sf)).select("company_id", "search_term", "total", "pages", "left_out")
