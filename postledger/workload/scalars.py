"""Queries on column functions and predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, html, predicates, records, rules, similarity, text
from ..functions.predicates import SearchRule
from ..operators.rules import tag_postings
from ..sources.registry import rule_patterns
from .registry import query
from .snapshots import _KEEP, PLACES
from .views import SQL_ALL, SQL_POST, all_postings, posting_base, table



def _c(name):
    return F.col(name)


# --- text -------------------------------------------------------------------------------
@query("normalize_title", r"""WITH t AS (SELECT p_partkey, ' ' || p_name || '  ' || p_type || CASE p_partkey % 4 WHEN 0 THEN ' (Remote) (m/f)'
    WHEN 1 THEN ' - URGENT hire' WHEN 2 THEN ' -newcastle' ELSE ' - Senior  ' END AS raw FROM part)
  SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(raw)), '\s*\(.*?\)\s*$', ''),
    '\s*-\s*(?:urgent|new|posted).*?$', ''), '\s+', ' ', 'g') AS title FROM t""")
def normalize_title(spark, sf):
    tail = ("CASE p_partkey % 4 WHEN 0 THEN ' (Remote) (m/f)' WHEN 1 THEN ' - URGENT hire' WHEN 2 THEN ' -newcastle' ELSE ' - Senior  ' END")
    raw = F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type", F.expr(tail))
    return table(spark, sf, "part").select("p_partkey", text.normalize_title(raw).alias("title"))


@query("normalize_location", r"""WITH t AS (SELECT doc_id, location || CASE doc_id % 4 WHEN 0 THEN ' (HQ), USA' WHEN 1 THEN ' , us ' WHEN 2 THEN ' (Bay  Area), CA'
    ELSE '  (x)' END AS raw FROM v_post)
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(raw)), '\s*,\s*usa?\s*$', ''), '\s*\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS place FROM t"""
       .replace("WITH t AS", SQL_POST + ", t AS", 1))
def normalize_location(spark, sf):
    tail = "CASE doc_id % 4 WHEN 0 THEN ' (HQ), USA' WHEN 1 THEN ' , us ' WHEN 2 THEN ' (Bay  Area), CA' ELSE '  (x)' END"
    raw = F.concat("location", F.expr(tail))
    return posting_base(spark, sf).select("doc_id", text.normalize_location(raw).alias("place"))


@query("normalize_company", r"""SELECT c_custkey, regexp_replace(trim(lower('  ' || c_name || '   ' || c_mktsegment || ' ')), '\s+', ' ', 'g') AS company FROM customer""")
def normalize_company(spark, sf):
    raw = F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", text.normalize_company(raw).alias("company"))


@query("content_hash", SQL_POST + " SELECT doc_id, sha256(company_name || '|' || title || '|' || location || '|' || description_text || '|' || apply_url) AS content_hash FROM v_post")
def content_hash(spark, sf):
    h = text.content_hash(*[_c(n) for n in ("company_name", "title", "location", "description_text", "apply_url")])
    return posting_base(spark, sf).select("doc_id", h.alias("content_hash"))


@query("fingerprint", SQL_POST + " SELECT doc_id, md5(lower(company_name) || '|' || lower(title) || '|' || lower(location) || '|' || apply_url) AS fingerprint FROM v_post")
def fingerprint(spark, sf):
    f = text.fingerprint(_c("company_name"), _c("title"), _c("location"), _c("apply_url"))
    return posting_base(spark, sf).select("doc_id", f.alias("fingerprint"))


_ENTITIES = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_HIDDEN = "".join(f"<{t}[^>]*>.*?</{t}>|" for t in ("script", "style", "noscript", "svg"))[:-1]
_NOTAGS = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is){_HIDDEN}', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '<[^>]+>', chr(10), 'g')"
_LINES = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
PAGE_TEXT_SQL = _LINES.format(_ENTITIES.format(_NOTAGS))


@query("page_text", f"WITH t AS (SELECT page_id, {PAGE_TEXT_SQL} AS content FROM pages) SELECT page_id, length(content) AS chars, sha256(content) AS digest FROM t")
def page_text(spark, sf):
    t = table(spark, sf, "pages").select("page_id", html.extract_text(_c("html")).alias("content"))
    return t.select("page_id", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("digest"))


_CLEAN = _LINES.format("regexp_replace(" + _ENTITIES.format("html") + ", '<[^>]+>', chr(10), 'g')")


@query("clean_html", f"SELECT page_id, sha256({_CLEAN}) AS digest FROM pages")
def clean_html(spark, sf):
    # the stored page is escaped first, as boards send it
    return table(spark, sf, "pages").select("page_id", F.sha2(html.clean_html(_c("html")), 256).alias("digest"))


@query("html_unescape", f"SELECT page_id, sha256({_ENTITIES.format('html')}) AS digest FROM pages")
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(html.html_unescape(_c("html")), 256).alias("digest"))


@query("truncate_text", """WITH t AS (SELECT doc_id, text, left(text, 500) AS head FROM documents),
  u AS (SELECT *, 500 - strpos(reverse(head), '.') AS dot, strpos(head, '.') > 0 AS has FROM t)
  SELECT doc_id, sha256(CASE WHEN length(text) <= 500 THEN text WHEN has AND dot > 400 THEN left(head, dot + 1) ELSE left(text, 497) || '...' END) AS digest FROM u""")
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.truncate_text(_c("text"), 500), 256).alias("digest"))


@query("flatten_scalar", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def flatten_scalar(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.flatten_scalar(_c("text")), 256).alias("digest"))


@query("escape_terminator", r"""SELECT doc_id, sha256(regexp_replace(replace(text, '. ', '.' || chr(10) || ' end Job ' || chr(10)),
  '(?mi)^\s*END JOB\s*$', 'END_JOB', 'g')) AS digest FROM documents""")
def escape_terminator(spark, sf):
    dirty = F.replace(_c("text"), F.lit(". "), F.lit(".\n end Job \n"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.escape_terminator(dirty, "END JOB"), 256).alias("digest"))


@query("cap_description", r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM documents)
  SELECT doc_id, sha256(CASE WHEN length(v) > 800 THEN left(v, 800) || ' [truncated]' ELSE v END) AS digest FROM t""")
def cap_description(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.cap_description(_c("text"), 800), 256).alias("digest"))


@query("uuid5_url", r"""WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS d FROM pages)
  SELECT page_id, left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
    lower(to_hex((CAST('0x' || substr(d, 17, 2) AS INT) & 63) + 128)) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS id FROM h""")
def uuid5_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.uuid5_url(_c("url")).alias("id"))


# --- dates --------------------------------------------------------------------------------
_POSTED = ("CASE event_id % 7 WHEN 0 THEN 'Posted Today' WHEN 1 THEN 'Just posted' WHEN 2 THEN 'Posted Yesterday' "
           "WHEN 3 THEN concat('Posted ', CAST(user_id % 30 AS STRING), ' Days Ago') WHEN 4 THEN 'Posted 30+ Days Ago' "
           "WHEN 5 THEN concat('Posted ', CAST(user_id % 5 AS STRING), ' Months Ago') ELSE 'Unknown' END")


@query("posted_on", f"""SELECT event_id, strftime(CASE event_id % 7 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts - to_days(1)
  WHEN 3 THEN ts - to_days(CAST(user_id % 30 AS INT)) WHEN 4 THEN ts - to_days(30) WHEN 5 THEN ts - to_days(CAST(user_id % 5 AS INT) * 30) END,
  '%Y-%m-%d %H:%M:%S') AS posted FROM events""")
def posted_on(spark, sf):
    when = dates.parse_posted_on(F.expr(_POSTED), _c("ts"))
    return table(spark, sf, "events").select("event_id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("parse_iso", """SELECT event_id, CASE event_id % 6 WHEN 4 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 5 THEN NULL
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS posted FROM events""")
def parse_iso(spark, sf):
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (F.when(_c("event_id") % 6 == 0, F.concat(local, F.lit("Z"))).when(_c("event_id") % 6 == 1, F.concat(local, F.lit("-05:00")))
           .when(_c("event_id") % 6 == 2, F.concat(local, F.lit(".123456+0530"))).when(_c("event_id") % 6 == 3, local)
           .when(_c("event_id") % 6 == 4, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit("next week")))
    out = dates.parse_iso(F.lit(""), _c("props"), raw)
    return table(spark, sf, "events").select("event_id", F.date_format(out, "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("week_dates", """SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('week', ts) WHEN 1 THEN date_trunc('day', ts)
    ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS posted FROM events""")
def week_dates(spark, sf):
    """Moments written as ISO week dates: the week alone, with the day, or with the day and a time."""
    parts = lambda p: F.lpad(F.expr(f"extract({p} FROM ts)").cast("string"), 2, "0")
    year, week, day = F.expr("extract(YEAROFWEEK FROM ts)").cast("string"), parts("WEEK"), F.expr("extract(DAYOFWEEK_ISO FROM ts)").cast("string")
    k = _c("event_id") % 3
    raw = (F.when(k == 0, F.concat(year, F.lit("-W"), week)).when(k == 1, F.concat(year, F.lit("W"), week, day))
           .otherwise(F.concat(year, F.lit("-W"), week, F.lit("-"), day, F.date_format("ts", "'T'HH:mm:ss"), F.lit("Z"))))
    return table(spark, sf, "events").select("event_id", F.date_format(dates.parse_iso(raw), "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("epoch_millis", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS posted FROM events")
def epoch_millis(spark, sf):
    millis = F.unix_millis(_c("ts").cast("timestamp")).cast("string")
    return table(spark, sf, "events").select("event_id", F.date_format(dates.epoch_millis(millis), "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("valid_through", "SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events")
def valid_through(spark, sf):
    raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf, "events").select("event_id", predicates.valid_through_expired(raw, F.lit("2024-01-15 00:00:00")).alias("expired"))


# --- rules --------------------------------------------------------------------------------
_WORDS = ("CASE doc_id % 9 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-Time' WHEN 2 THEN 'Contract' WHEN 3 THEN 'Temporary' "
          "WHEN 4 THEN 'Internship' WHEN 5 THEN 'FullTime' WHEN 6 THEN 'PartTime' WHEN 7 THEN 'Seasonal' ELSE '' END")


@query("employment_type", f"""WITH t AS (SELECT doc_id, doc_id % 9 AS k, {_WORDS} AS w FROM documents)
  SELECT doc_id,
    CASE k WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'contract' WHEN 4 THEN 'apprenticeship' ELSE 'unknown' END AS lever,
    CASE k WHEN 5 THEN 'full_time' WHEN 6 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'temporary' WHEN 4 THEN 'apprenticeship' ELSE 'unknown' END AS ashby,
    CASE k WHEN 1 THEN 'part_time' WHEN 6 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'temporary' ELSE 'full_time' END AS jsonld,
    CASE WHEN doc_id % 11 = 0 THEN 'apprenticeship' ELSE CASE k WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'temporary'
      WHEN 7 THEN 'temporary' ELSE 'unknown' END END AS workday FROM t""")
def employment_type(spark, sf):
    w = F.expr(_WORDS)
    title = F.when(_c("doc_id") % 11 == 0, F.lit("Electrical Apprentice")).otherwise(F.lit("Clerk"))
    return table(spark, sf, "documents").select(
        "doc_id", rules.lever_employment(w).alias("lever"), rules.ashby_employment(w).alias("ashby"),
        rules.jsonld_employment(w).alias("jsonld"), rules.workday_employment(w, title).alias("workday"))


_PLACEWORDS = ("CASE doc_id % 8 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'On-Site' WHEN 3 THEN 'OnSite' WHEN 4 THEN 'TELECOMMUTE' "
               "WHEN 5 THEN 'on_site' WHEN 6 THEN 'Hybrid remote' ELSE '' END")


@query("remote_status", """WITH t AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
  SELECT doc_id, CASE k WHEN 0 THEN 'remote' WHEN 6 THEN 'remote' ELSE 'unknown' END AS greenhouse,
    CASE k WHEN 0 THEN 'remote' WHEN 6 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'on_site' WHEN 3 THEN 'on_site' ELSE 'unknown' END AS lever,
    CASE WHEN k IN (1, 6) THEN 'hybrid' WHEN k = 0 THEN 'remote' WHEN k = 3 THEN 'on_site' WHEN doc_id % 3 = 0 THEN 'remote' ELSE 'unknown' END AS ashby,
    CASE k WHEN 0 THEN 'remote' WHEN 6 THEN 'remote' WHEN 4 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'on_site' WHEN 5 THEN 'on_site' ELSE 'unknown' END AS jsonld,
    CASE WHEN k IN (1, 6) THEN 'hybrid' WHEN k = 0 THEN 'remote' ELSE 'unknown' END AS workday FROM t""")
def remote_status(spark, sf):
    w = F.expr(_PLACEWORDS)
    return table(spark, sf, "documents").select(
        "doc_id", rules.greenhouse_remote(w, F.lit("an office")).alias("greenhouse"), rules.lever_remote(w).alias("lever"),
        rules.ashby_remote(w, _c("doc_id") % 3 == 0).alias("ashby"), rules.jsonld_remote(w).alias("jsonld"),
        rules.workday_remote(w, F.lit("Clerk")).alias("workday"))


@query("format_address", """SELECT n_nationkey, c_custkey, n_name || CASE WHEN c_custkey % 2 = 0 THEN ', ' || r_name ELSE '' END ||
  CASE WHEN c_custkey % 3 = 0 THEN ', DE' ELSE '' END AS address FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def format_address(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), _c("n_nationkey") == _c("c_nationkey")).join(
        table(spark, sf, "region"), _c("r_regionkey") == _c("n_regionkey"))
    region = F.when(_c("c_custkey") % 2 == 0, _c("r_name")).otherwise(F.lit(""))
    country = F.when(_c("c_custkey") % 3 == 0, F.lit("DE")).when(_c("c_custkey") % 3 == 1, F.lit("usa"))
    return c.select("n_nationkey", "c_custkey", rules.format_address(_c("n_name"), region, country).alias("address"))


@query("workday_paths", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'JR' || p_partkey WHEN 1 THEN 'R-' || p_partkey
    ELSE '/job/New-York-NY/' || replace(p_name, ' ', '-') END AS requisition,
  CASE p_partkey % 3 WHEN 0 THEN 'Round Rock TX' WHEN 1 THEN 'Paris' ELSE 'New York NY' END AS place FROM part""")
def workday_paths(spark, sf):
    key = _c("p_partkey").cast("string")
    slug = F.replace(_c("p_name"), F.lit(" "), F.lit("-"))
    kind = _c("p_partkey") % 3
    path = (F.when(kind == 0, F.concat(F.lit("/job/Round-Rock-TX/"), slug, F.lit("_JR"), key))
            .when(kind == 1, F.concat(F.lit("/job/Elsewhere/"), slug, F.lit("_R-"), key))
            .otherwise(F.concat(F.lit("/job/New-York-NY/"), slug)))
    given = F.when(kind == 0, F.lit("2 Locations")).when(kind == 1, F.lit("Paris")).otherwise(F.lit(""))
    return table(spark, sf, "part").select("p_partkey", rules.requisition_id(path).alias("requisition"),
                                           rules.summary_location(path, given).alias("place"))


@query("tenant_coordinates", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'given' ELSE 'acme-' || s_suppkey END AS tenant,
  CASE WHEN s_suppkey % 3 = 2 THEN 'wd1' ELSE 'wd' || s_suppkey % 9 END AS host, CASE WHEN s_suppkey % 3 = 2 THEN 'Jobs' ELSE 'Careers_' || s_nationkey END AS site FROM supplier""")
def tenant_coordinates(spark, sf):
    n = _c("s_suppkey").cast("string")
    locale = F.when(_c("s_suppkey") % 3 == 1, F.lit("en-US/")).otherwise(F.lit(""))
    url = F.concat(F.lit("https://acme-"), n, F.lit(".wd"), (_c("s_suppkey") % 9).cast("string"), F.lit(".myworkdayjobs.com/"), locale,
                   F.lit("Careers_"), _c("s_nationkey").cast("string"), F.lit("/job/1"))
    given = lambda v: F.when(_c("s_suppkey") % 3 == 2, F.lit(v))
    at = rules.tenant_coordinates(given("given"), F.lit(None).cast("string"), given("Jobs"), url)
    return table(spark, sf, "supplier").select("s_suppkey", at.alias("at")).select("s_suppkey", "at.*")


@query("salary_range", """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE '$' || format('{:,}', CAST(p_size AS BIGINT) % 10 * 12345) || ' - $' ||
  format('{:,}', 1000 + p_partkey * 1000) || '.5 year' END AS salary FROM part""")
def salary_range(spark, sf):
    low = ((_c("p_size") % 10) * 12345).cast("string")
    high = F.concat((_c("p_partkey") * 1000 + 1000).cast("string"), F.lit(".5"))
    return table(spark, sf, "part").select("p_partkey", rules.salary_range(low, high, F.lit("year")).alias("salary"))


# --- predicates ---------------------------------------------------------------------------
@query("location_filter", SQL_POST + f" SELECT doc_id, location FROM v_post WHERE {_KEEP}")
def location_filter(spark, sf):
    return posting_base(spark, sf).filter(PLACES.matches(_c("location"))).select("doc_id", "location")


RULES = (
    SearchRule("red things", True, (), ("red", "blue widget"), ("promo",)),
    SearchRule("african rings", False, ("AFRICA",), ("ring",), ()),
    SearchRule("economy", False, ("NATION_1", "NATION_2"), ("economy",), ("small",)),
)


@query("search_rules", SQL_POST + r""" SELECT doc_id, concat_ws(', ',
    CASE WHEN (contains(lower(title), 'red') OR contains(lower(title), 'blue widget')) AND NOT contains(lower(title), 'promo') THEN 'red things' END,
    CASE WHEN contains(lower(title), 'ring') AND regexp_matches(location, '(?i)\bAFRICA\b') THEN 'african rings' END,
    CASE WHEN contains(lower(title), 'economy') AND NOT contains(lower(title), 'small') AND regexp_matches(location, '(?i)\bNATION_1\b|\bNATION_2\b') THEN 'economy' END) AS rules FROM v_post""")
def search_rules(spark, sf):
    tags = predicates.matching_rules(RULES, _c("title"), _c("location"))
    return posting_base(spark, sf).select("doc_id", F.array_join(tags, ", ").alias("rules"))


_MANY_RULES_SQL = SQL_POST + r""", r AS (SELECT p_brand || '-' || p_partkey AS name, p_partkey % 2 = 0 AS nationwide, lower(p_name) AS inc,
    CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) END AS exc, '(?i)\bNATION_' || (p_partkey % 25) || '\b' AS spot FROM part),
  t AS (SELECT DISTINCT lower(title) AS title, location FROM v_post),
  h AS (SELECT title, location, string_agg(name, ',' ORDER BY name) AS rules, count(*) AS n FROM t JOIN r ON contains(title, inc) AND NOT contains(title, coalesce(exc, 'no such word'))
    AND (nationwide OR regexp_matches(location, spot)) GROUP BY ALL)
  SELECT doc_id, coalesce(n, 0) AS n, sha256(coalesce(rules, '')) AS digest FROM v_post p LEFT JOIN h ON h.title = lower(p.title) AND h.location = p.location"""


@query("many_search_rules", _MANY_RULES_SQL)
def many_search_rules(spark, sf):
    """Every posting against one rule for each part, as a join on character groups."""
    k = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        F.concat_ws("-", "p_brand", k.cast("string")).alias("name"), (k % 2 == 0).alias("nationwide"),
        F.array(F.concat(F.lit("NATION_"), (k % 25).cast("string"))).alias("locations"), F.array("p_name").alias("include_titles"),
        F.when(k % 3 == 0, F.array("p_type")).alias("exclude_titles"))
    return tag_postings(posting_base(spark, sf), rule_patterns(raw), "doc_id", {
        "n": F.size("rules").cast("long"), "digest": F.sha2(F.array_join("rules", ","), 256)})


@query("soft_404", f"""WITH t AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Page can''t be found' || chr(10) WHEN page_id % 4 = 1 THEN repeat('x', 1995) || '404 page' ELSE '' END
    || {PAGE_TEXT_SQL} AS v FROM pages) SELECT page_id, page_id % 4 = 0 AS missing FROM t""")
def soft_404(spark, sf):
    head = (F.when(_c("page_id") % 4 == 0, F.lit("Page can't be found\n"))
            .when(_c("page_id") % 4 == 1, F.concat(F.repeat(F.lit("x"), 1995), F.lit("404 page"))).otherwise(F.lit("")))
    t = table(spark, sf, "pages").select("page_id", F.concat(head, html.extract_text(_c("html"))).alias("v"))
    return t.select("page_id", predicates.soft_404(_c("v")).alias("missing"))


@query("inventory", SQL_ALL + """ SELECT internal_id, 'delta' AS selection FROM v_all WHERE status IN ('new', 'changed')
  UNION ALL SELECT internal_id, 'all' FROM v_all""")
def inventory(spark, sf):
    p = all_postings(spark, sf)
    pick = lambda k: p.filter(predicates.in_inventory(_c("status"), k)).select("internal_id", F.lit(k).alias("selection"))
    return pick("delta").unionByName(pick("all"))


# --- records ------------------------------------------------------------------------------
_SCALAR = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
RECORD_SQL = r"""'JOB' || chr(10) || 'id: ' || source_id || '|' || source_job_id || chr(10) || 'company: ' || company_name || chr(10) ||
  'title: ' || title || chr(10) || 'location: ' || location || chr(10) || 'employment_type: ' || employment_type || chr(10) ||
  'remote: ' || remote_status || chr(10) || 'status: ' || status || chr(10) || 'posted_date: ' || strftime(date_posted, '%Y-%m-%d') || chr(10) ||
  'first_seen: ' || strftime(first_seen_at, '%Y-%m-%d') || chr(10) || 'source: ' || source_id || chr(10) || 'salary: ' || salary_text || chr(10) ||
  'apply_url: ' || apply_url || chr(10) || 'description:' || chr(10) ||
  regexp_replace(CASE WHEN length(v_text) > 2000 THEN left(v_text, 2000) || ' [truncated]' ELSE v_text END, '(?mi)^\s*END JOB\s*$', 'END_JOB', 'g')
  || chr(10) || 'END JOB' || chr(10)"""
RECORDS_SQL = SQL_ALL + r""", v_rec AS (SELECT *, """ + RECORD_SQL + r""" AS record
  FROM (SELECT *, regexp_replace(description_text, '^\s+|\s+$', '', 'g') AS v_text FROM v_all))"""


@query("job_records", RECORDS_SQL + " SELECT internal_id, sha256(record) AS digest, octet_length(encode(record)) + 1 AS bytes FROM v_rec")
def job_records(spark, sf):
    r = all_postings(spark, sf).select("internal_id", records.job_record().alias("record"))
    return r.select("internal_id", F.sha2("record", 256).alias("digest"), records.record_bytes(_c("record")).cast("long").alias("bytes"))


@query("keywords_found", """SELECT doc_id, array_to_string(list_filter(['The', 'apply now', 'QUE', 'der'], lambda k: contains(lower(text), lower(k))), ', ') AS found FROM documents""")
def keywords_found(spark, sf):
    kws = F.array(*[F.lit(k) for k in ("The", "apply now", "QUE", "der")])
    return table(spark, sf, "documents").select("doc_id", F.array_join(records.keywords_found(_c("text"), kws), ", ").alias("found"))


@query("markdown_posting", SQL_ALL + r""" SELECT internal_id, sha256(chr(10) || '### ' || title || chr(10) || '**' || company_name || '** | ' || location || chr(10) ||
  '*' || employment_type || '*' || chr(10) || '*Remote: ' || remote_status || '*' || chr(10) ||
  CASE WHEN salary_text <> '' THEN '**Salary:** ' || salary_text || chr(10) ELSE '' END ||
  CASE WHEN description_text <> '' THEN chr(10) || left(description_text, 500) || CASE WHEN length(description_text) > 500 THEN '...' ELSE '' END || chr(10) ELSE '' END ||
  '[Apply](' || apply_url || ')') AS digest FROM v_all""")
def markdown_posting(spark, sf):
    return all_postings(spark, sf).select("internal_id", F.sha2(records.markdown_posting(), 256).alias("digest"))


@query("title_similarity", """WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS a, p_type || ' ' || p_brand AS b FROM part)
  SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS similarity,
    round(40 * (CASE WHEN a = b THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END) + 30 + CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 9 ELSE 0 END, 6) / 100 AS score FROM t""")
def title_similarity(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"), F.concat_ws(" ", "p_type", "p_brand").alias("b"))
    s = similarity.string_similarity(_c("a"), _c("b"))
    k = _c("p_partkey") % 3
    return t.select("p_partkey", F.round(s, 9).alias("similarity"), similarity.score(F.lit(True), s, F.lit(False), k == 0, k == 1).alias("score"))
