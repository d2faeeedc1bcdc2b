"""Queries on feeds, messages and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import feed, report
from ..operators.ordering import global_positions
from .registry import query
from .scalars import RECORDS_SQL
from .views import RUN_AT, SQL_ALL, all_postings, table

_ORDER = "CASE WHEN status = 'new' THEN 0 ELSE 1 END, company_name, title, internal_id"
_SIZED = RECORDS_SQL + """, v_size AS (SELECT *, octet_length(encode(record)) + 1 AS bytes FROM v_rec)"""
_FIT = f"""v_fit AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank, sum(bytes) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS used
  FROM v_size WHERE status IN ('new', 'changed')) WHERE rank <= 400 AND (rank = 1 OR used <= 90000))"""


@query("feed_positions", SQL_ALL + f""" SELECT internal_id, row_number() OVER (ORDER BY {_ORDER}) - 1 AS pos,
  CAST(sum(length(title)) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM v_all WHERE status IN ('new', 'changed')""")
def feed_positions(spark, sf):
    p = all_postings(spark, sf).filter("status in ('new', 'changed')").select("internal_id", "status", "company_name", "title")
    out = global_positions(p, feed.feed_order("delta"), F.length("title"), rows_per_block=2000)
    return out.select("internal_id", "pos", "cum")


@query("feed_prefix", _SIZED + f", {_FIT} SELECT internal_id, rank, CAST(used AS BIGINT) AS used FROM v_fit")
def feed_prefix(spark, sf):
    fit = feed.fit_message(feed.feed_records(all_postings(spark, sf)))
    return fit.select("internal_id", "rank", "used")


_BATCHES = """
  o AS (SELECT internal_id, record, bytes, row_number() OVER (ORDER BY company_name, title, internal_id) - 1 AS pos FROM v_size),
  walk AS (SELECT pos, 0 AS batch, bytes AS used, 1 AS n FROM o WHERE pos = 0
    UNION ALL SELECT o.pos, CASE WHEN w.used + o.bytes > 88000 OR w.n >= 400 THEN w.batch + 1 ELSE w.batch END,
      CASE WHEN w.used + o.bytes > 88000 OR w.n >= 400 THEN o.bytes ELSE w.used + o.bytes END,
      CASE WHEN w.used + o.bytes > 88000 OR w.n >= 400 THEN 1 ELSE w.n + 1 END
    FROM walk w JOIN o ON o.pos = w.pos + 1)"""


@query("feed_batches", _SIZED.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_BATCHES} SELECT internal_id, pos, CAST(batch AS BIGINT) AS batch FROM o JOIN walk USING (pos)")
def feed_batches(spark, sf):
    sized = feed.feed_records(all_postings(spark, sf), "all").drop("record")
    return feed.pack_batches(sized, feed.feed_order("all"))


@query("feed_coverage", _SIZED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_BATCHES} SELECT count(*) AS offered, count(*) FILTER (WHERE batch < 3) AS sent,
  count(*) FILTER (WHERE batch >= 3) AS omitted FROM walk""")
def feed_coverage(spark, sf):
    sized = feed.feed_records(all_postings(spark, sf), "all").drop("record")
    return feed.covered(sized, feed.pack_batches(sized, feed.feed_order("all")), 3)


def _watches(spark, sf):
    """Page states as a watch list: one in four pages changed, one in fifty failed."""
    k = F.col("page_id")
    status = F.when(k % 50 == 7, F.lit("error")).when(k % 4 == 0, F.lit("changed")).otherwise(F.lit("unchanged"))
    return table(spark, sf, "pages").select(
        F.format_string("w%09d", "page_id").alias("id"), F.concat(F.lit(" Page  "), k.cast("string")).alias("name"), "url", status.alias("status"),
        F.concat(F.lit("Added "), F.col("url")).alias("added_text"), F.array(F.lit("apply"), F.lit("open")).alias("keywords_found"),
        F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("last_changed_at"),
        F.when(k % 50 == 7, F.lit("HTTP error: 503")).otherwise(F.lit("")).alias("error"))


_WATCHES = r"""v_watch AS (SELECT 'w' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS id, 'WATCH' || chr(10) || 'id: w' || lpad(CAST(page_id AS VARCHAR), 9, '0') || chr(10) ||
    'name: Page ' || page_id || chr(10) || 'url: ' || url || chr(10) || 'status: ' || CASE WHEN page_id % 50 = 7 THEN 'error' ELSE 'changed' END || chr(10) ||
    'keywords_found: apply, open' || chr(10) || 'last_changed: 2024-01-20' || chr(10) || 'error: ' || CASE WHEN page_id % 50 = 7 THEN 'HTTP error: 503' ELSE '' END || chr(10) ||
    'added_text:' || chr(10) || 'Added ' || url || chr(10) || 'END WATCH' || chr(10) AS record FROM pages WHERE page_id % 50 = 7 OR page_id % 4 = 0)"""


@query("watch_records", "WITH " + _WATCHES + " SELECT id, record FROM v_watch")
def watch_records(spark, sf):
    return _watches(spark, sf).filter("status <> 'unchanged'").select("id", records.watch_record().alias("record"))


def _header(part, total, included, omitted, watches, changed):
    return f"""'=== POSTING REPORT ===' || chr(10) || 'generated_at: 2024-02-01T06:00:00Z' || chr(10) || 'total_active: ' || (SELECT count(*) FROM v_all) || chr(10) ||
  'new: ' || (SELECT count(*) FROM v_all WHERE status = 'new') || chr(10) || 'changed: ' || (SELECT count(*) FROM v_all WHERE status = 'changed') || chr(10) ||
  'expired: 0' || chr(10) || 'failed_sources: 2' || chr(10) || 'part: ' || {part} || ' of ' || {total} || chr(10) || 'records_included: ' || {included} || chr(10) ||
  {omitted} || 'watches_checked: ' || {watches} || chr(10) || 'watches_changed: ' || {changed} || chr(10)"""


_CHANGED = "(SELECT count(*) FROM pages WHERE page_id % 50 <> 7 AND page_id % 4 = 0)"
_OMITTED = """CASE WHEN {0} > 0 THEN 'records_omitted: ' || {0} || ' (' || CASE WHEN count(*) >= 400 THEN 'record cap' ELSE 'body size limit' END ||
  '; ordered new-first, so omitted records are the lowest priority)' || chr(10) ELSE '' END"""


def _rows_sql(parts, jobs):
    return f"""SELECT part, 0 AS section, 0 AS pos, '' AS key, sha256(header) AS digest FROM {parts} UNION ALL SELECT 1, 1, 0, id, sha256(record) FROM v_watch
  UNION ALL SELECT part, 2, pos, '', sha256(record) FROM {jobs} UNION ALL SELECT part, 3, 0, '', sha256('=== END REPORT ===') FROM {parts}"""


def _digests(rows):
    return rows.select("part", "section", "pos", "key", F.sha2("text", 256).alias("digest"))


@query("feed_message", _SIZED + f", {_FIT}, {_WATCHES}, m AS (SELECT 1 AS part, " + _header(
    "1", "1", "count(*)", _OMITTED.format("((SELECT count(*) FROM v_all WHERE status IN ('new', 'changed')) - count(*))"),
    "(SELECT count(*) FROM pages)", _CHANGED) + " AS header FROM v_fit), j AS (SELECT 1 AS part, rank AS pos, record FROM v_fit) " + _rows_sql("m", "j"))
def feed_message(spark, sf):
    return _digests(feed.single_message(all_postings(spark, sf), _watches(spark, sf), F.lit(RUN_AT).cast("timestamp_ntz"), failed_sources=2))


@query("feed_parts", _SIZED.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_BATCHES}, {_WATCHES}, m AS (SELECT batch + 1 AS part, " + _header(
    "(batch + 1)", "(SELECT max(batch) + 1 FROM walk)", "count(*)", "''", "CASE WHEN batch = 0 THEN (SELECT count(*) FROM pages) ELSE 0 END",
    f"CASE WHEN batch = 0 THEN {_CHANGED} ELSE 0 END") + " AS header FROM walk GROUP BY batch), j AS (SELECT batch + 1 AS part, pos, record FROM o JOIN walk USING (pos)) "
       + _rows_sql("m", "j"))
def feed_parts(spark, sf):
    return _digests(feed.batch_messages(all_postings(spark, sf), _watches(spark, sf), F.lit(RUN_AT).cast("timestamp_ntz"), failed_sources=2))


@query("feed_parts_limited", _SIZED.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_BATCHES}, {_WATCHES}, m AS (SELECT batch + 1 AS part, " + _header(
    "(batch + 1)", "(SELECT max(batch) + 1 FROM walk)", "count(*)", "(SELECT CASE WHEN count(*) > 0 THEN 'records_omitted: ' || count(*) || ' (part limit; ordered new-first, so omitted records are the lowest priority)' || chr(10) ELSE '' END FROM walk WHERE batch >= 2)",
    "CASE WHEN batch = 0 THEN (SELECT count(*) FROM pages) ELSE 0 END",
    f"CASE WHEN batch = 0 THEN {_CHANGED} ELSE 0 END") + " AS header FROM walk WHERE batch < 2 GROUP BY batch), j AS (SELECT batch + 1 AS part, pos, record FROM o JOIN walk USING (pos) WHERE batch < 2) "
       + _rows_sql("m", "j"))
def feed_parts_limited(spark, sf):
    return _digests(feed.batch_messages(all_postings(spark, sf), _watches(spark, sf), F.lit(RUN_AT).cast("timestamp_ntz"), max_parts=2, failed_sources=2))


@query("json_report_rows", SQL_ALL + """ SELECT status, source_type AS source, source_job_id AS source_id, company_name AS company, title, location, employment_type,
  remote_status, salary_text AS salary, sha256(left(description_text, 2000)) AS digest, apply_url, strftime(date_posted, '%Y-%m-%dT%H:%M:%S') AS posted_date,
  strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S') AS first_seen, 0 AS warnings FROM v_all WHERE status IN ('new', 'changed', 'expired')""")
def json_report_rows(spark, sf):
    r = report.json_rows(all_postings(spark, sf))
    return r.withColumn("digest", F.sha2("description", 256)).withColumn("warnings", F.size("warnings")).drop("description")


_MD = r"""v_md AS (SELECT *, CASE WHEN category IN ('Software development', 'QA and testing') THEN 1 WHEN category IN ('Electrical trade', 'HVAC trade', 'Construction and general labor') THEN 2
    WHEN contains(location, 'TX') OR contains(location, 'Texas') OR contains(location, 'Austin') THEN 3 ELSE 4 END AS b FROM v_all WHERE status IN ('new', 'changed'))"""


_SECTION = """CASE WHEN status = 'changed' THEN 'Changed Jobs' WHEN b = 1 THEN 'New Software & QA Jobs' WHEN b = 2 THEN 'New Trades & Immediate Income Jobs'
    WHEN b = 3 THEN 'New Austin-Area Technical Jobs' ELSE 'Other New Jobs' END"""
_LINE = """CASE WHEN status = 'new' AND b = 4 THEN '- [' || title || '](' || apply_url || ') — ' || company_name || ', ' || location
  ELSE chr(10) || '### ' || title || chr(10) || '**' || company_name || '** | ' || location || CASE WHEN employment_type <> '' THEN chr(10) || '*' || employment_type || '*' ELSE '' END
    || CASE WHEN remote_status <> '' THEN chr(10) || '*Remote: ' || remote_status || '*' ELSE '' END || CASE WHEN salary_text <> '' THEN chr(10) || '**Salary:** ' || salary_text ELSE '' END
    || CASE WHEN description_text <> '' THEN chr(10) || chr(10) || left(description_text, 500) || CASE WHEN length(description_text) > 500 THEN '...' ELSE '' END ELSE '' END
    || chr(10) || '[Apply](' || apply_url || ')' END"""


@query("markdown_report", SQL_ALL + f""", {_MD}, posts AS (SELECT {_SECTION} AS section, internal_id, {_LINE} AS line FROM v_md)
  SELECT section, internal_id, sha256(line) AS digest FROM posts
  UNION ALL SELECT section, NULL, sha256(chr(10) || '## ' || section || ' (' || count(*) || ')') FROM posts GROUP BY section
  UNION ALL SELECT 'header', NULL, sha256(unnest(['# Job Collection Report', chr(10) || '**Generated:** 2024-02-01T06:00:00Z', '**Sources checked:** 5', '**Status:** 4 successful, 1 failed']))""")
def markdown_report(spark, sf):
    rows = report.markdown_rows(all_postings(spark, sf), F.lit(RUN_AT).cast("timestamp_ntz"), 5, 4, 1)
    return rows.select("section", "internal_id", F.sha2("line", 256).alias("digest"))


@query("markdown_headings", SQL_ALL + f""", {_MD} SELECT CASE WHEN status = 'changed' THEN 'Changed Jobs' WHEN b = 1 THEN 'New Software & QA Jobs' WHEN b = 2 THEN 'New Trades & Immediate Income Jobs'
    WHEN b = 3 THEN 'New Austin-Area Technical Jobs' ELSE 'Other New Jobs' END AS section, count(*) AS postings FROM v_md GROUP BY 1""")
def markdown_headings(spark, sf):
    rows = report.markdown_rows(all_postings(spark, sf), F.lit(RUN_AT).cast("timestamp_ntz"), 5, 4, 1)
    heads = rows.filter("section_ord > 0 and row_ord = 0")
    return heads.select("section", F.regexp_extract("line", r"\((\d+)\)$", 1).cast("long").alias("postings"))


