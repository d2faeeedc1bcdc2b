"""Posting, log and page views over the given tables.

Each view exists twice: as a DataFrame here and as SQL text for the comparison.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, internal_id, source_id
from ..schemas import as_postings

RUN_AT = "2024-02-01 06:00:00"

_TYPE = ("CASE CAST(floor({0} / 100.0) AS INT) % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' "
         "WHEN 2 THEN 'ashby' WHEN 3 THEN 'jsonld' ELSE 'workday' END")
TYPE_OF_DOC = _TYPE.format("doc_id")
EMPLOYMENT = ("CASE doc_id % 6 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' "
              "WHEN 3 THEN 'temporary' WHEN 4 THEN 'apprenticeship' ELSE 'unknown' END")
REMOTE = "CASE doc_id % 4 WHEN 0 THEN 'on_site' WHEN 1 THEN 'remote' WHEN 2 THEN 'hybrid' ELSE 'unknown' END"
CATEGORY = ("CASE doc_id % 7 WHEN 0 THEN 'Software development' WHEN 1 THEN 'QA and testing' "
            "WHEN 2 THEN 'HVAC trade' WHEN 3 THEN 'Electrical trade' ELSE '' END")
STATUS_OF_EVENT = ("CASE event_type WHEN 'click' THEN 'new' WHEN 'view' THEN 'unchanged' "
                   "WHEN 'purchase' THEN 'changed' WHEN 'signup' THEN 'reopened' ELSE 'source_error' END")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def posting_base(spark: SparkSession, sf: str) -> DataFrame:
    """One posting per document, with title and place from the dimensions."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    # several documents share a title, and there are more titles where there are more parts
    titles = F.floor(table(spark, sf, "part").agg(F.count("*")).scalar() / 10)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nk"), F.concat_ws(", ", "n_name", "r_name").alias("location"))
    return (
        d.join(p, F.col("doc_id") % titles == F.col("pk")).join(n, F.col("doc_id") % 25 == F.col("nk"))
        .select(
            "doc_id",
            F.col("source").alias("source_company_id"),
            F.expr(TYPE_OF_DOC).alias("source_type"),
            F.col("doc_id").cast("string").alias("source_job_id"),
            F.col("source").alias("company_name"), "title", "location",
            F.concat(F.lit("https://jobs.example.com/apply/"), (F.col("doc_id") % 150).cast("string")).alias("apply_url"),
            F.concat(F.lit("https://jobs.example.com/view/"), (F.col("doc_id") % 70).cast("string")).alias("source_url"),
            F.col("text").alias("description_text"),
            F.expr(EMPLOYMENT).alias("employment_type"), F.expr(REMOTE).alias("remote_status"),
            F.expr(CATEGORY).alias("category"),
            F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('$', CAST(doc_id % 90 + 10 AS STRING), 'k') ELSE '' END").alias("salary_text"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.expr("CAST(doc_id % 28 AS INT)"))).alias("date_posted"),
        )
    )


def _finish(base: DataFrame, *extra: str) -> DataFrame:
    hashed = base.withColumns({
        "source_id": source_id(F.col("source_company_id"), F.col("source_type")),
        "content_hash": content_hash(F.col("company_name"), F.col("title"), F.col("location"),
                                     F.col("description_text"), F.col("apply_url")),
    })
    return as_postings(hashed, *extra)


def all_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with their id and a status by document id."""
    out = _finish(posting_base(spark, sf), "doc_id")
    status = ("CASE doc_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'unchanged' "
              "WHEN 3 THEN 'new' ELSE 'reopened' END")
    return out.withColumns({
        "internal_id": internal_id(F.col("source_id"), F.col("source_job_id")),
        "status": F.expr(status),
        "first_seen_at": F.col("date_posted"),
    })


def current_postings(spark: SparkSession, sf: str) -> DataFrame:
    base = posting_base(spark, sf).filter("doc_id % 9 <> 1")
    altered = F.when(F.col("doc_id") % 7 == 3, F.concat("description_text", F.lit(" updated"))).otherwise(F.col("description_text"))
    return _finish(base.withColumn("description_text", altered))


def previous_state(spark: SparkSession, sf: str) -> DataFrame:
    out = _finish(posting_base(spark, sf).filter("doc_id % 11 <> 0"), "doc_id")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return out.withColumns({
        "internal_id": internal_id(F.col("source_id"), F.col("source_job_id")),
        "first_seen_at": at("2024-01-02 00:00:00"),
        "last_seen_at": at("2024-01-31 06:00:00"),
        "last_changed_at": at("2024-01-15 00:00:00"),
        "active": F.col("doc_id") % 13 != 0,
        "state_version": F.lit(1),
    }).drop("doc_id")


def observation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows from events; the posting is the document with the user's number."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("observed_at"), "user_id", "event_type")
    source = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit("#"), F.expr(_TYPE.format("user_id")))
    run = F.lpad(F.col("event_id").cast("string"), 12, "0")
    return e.select(
        run.alias("run_id"), run.alias("observation_id"), "observed_at",
        F.concat(source, F.lit("#"), F.col("user_id").cast("string")).alias("internal_id"),
        source.alias("source_id"), F.col("user_id").cast("string").alias("source_job_id"),
        F.md5(F.col("event_id").cast("string")).alias("content_hash"), F.expr(STATUS_OF_EVENT).alias("status"),
    )


def response_log(spark: SparkSession, sf: str) -> DataFrame:
    """Stored responses from events: errors become failed responses."""
    e = table(spark, sf, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("company_id"),
        F.expr(_TYPE.format("(user_id * 100)")).alias("source_type"),
        F.lit("https://acme.wd5.myworkdayjobs.com/Careers").alias("source_key"),
        F.lit("board").alias("page_kind"), F.col("event_id").cast("int").alias("page_seq"),
        F.lit(None).cast("string").alias("search_term"), F.lit(0).alias("term_ord"),
        F.lit(None).cast("string").alias("request_path"), F.lit(None).cast("string").alias("final_url"),
        F.when(~failed, F.lit(200)).when(F.col("event_id") % 3 == 0, F.lit(404)).when(F.col("event_id") % 3 == 1, F.lit(500)).alias("http_status"),
        F.when(failed & (F.col("event_id") % 3 == 2), F.lit("Request timeout")).alias("error"),
        F.lit(None).cast("map<string,string>").alias("options"), F.lit(None).cast("string").alias("body"),
    )


# --- the same views as SQL ------------------------------------------------------------
_POST = f"""
v_post AS (
  SELECT d.doc_id, d.source AS source_company_id, {TYPE_OF_DOC} AS source_type,
    d.source || '#' || {TYPE_OF_DOC} AS source_id,
    CAST(d.doc_id AS VARCHAR) AS source_job_id, d.source AS company_name,
    p.p_name || ' ' || p.p_type AS title, n.n_name || ', ' || r.r_name AS location,
    'https://jobs.example.com/apply/' || CAST(d.doc_id % 150 AS VARCHAR) AS apply_url,
    'https://jobs.example.com/view/' || CAST(d.doc_id % 70 AS VARCHAR) AS source_url,
    d.text AS description_text, {EMPLOYMENT} AS employment_type, {REMOTE} AS remote_status, {CATEGORY} AS category,
    CASE WHEN doc_id % 3 = 0 THEN '$' || CAST(doc_id % 90 + 10 AS VARCHAR) || 'k' ELSE '' END AS salary_text,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 28 AS INT)) AS date_posted
  FROM documents d JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) // 10 FROM part)
    JOIN nation n ON n.n_nationkey = d.doc_id % 25 JOIN region r ON r.r_regionkey = n.n_regionkey)"""
_HASH = "sha256(company_name || '|' || title || '|' || location || '|' || description_text || '|' || apply_url)"

SQL_POST = f"WITH {_POST}"
SQL_ALL = f"""WITH {_POST}, v_all AS (
  SELECT *, source_id || '#' || source_job_id AS internal_id, {_HASH} AS content_hash, date_posted AS first_seen_at,
    CASE doc_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'new' ELSE 'reopened' END AS status
  FROM v_post)"""
SQL_DIFF = f"""WITH {_POST}, cur AS (
  SELECT * REPLACE (CASE WHEN doc_id % 7 = 3 THEN description_text || ' updated' ELSE description_text END AS description_text)
  FROM v_post WHERE doc_id % 9 <> 1),
c AS (SELECT *, {_HASH} AS content_hash FROM cur),
s AS (SELECT *, {_HASH} AS content_hash, doc_id % 13 <> 0 AS active FROM v_post WHERE doc_id % 11 <> 0),
diff AS (
  SELECT COALESCE(c.source_id, s.source_id) AS source_id, COALESCE(c.source_job_id, s.source_job_id) AS source_job_id,
    COALESCE(c.source_id, s.source_id) || '#' || COALESCE(c.source_job_id, s.source_job_id) AS internal_id,
    COALESCE(c.title, s.title) AS title, COALESCE(c.category, s.category) AS category, COALESCE(c.location, s.location) AS location,
    COALESCE(c.content_hash, s.content_hash) AS content_hash, s.content_hash AS previous_hash, s.active AS was_active,
    c.source_id IS NOT NULL AS seen,
    CASE WHEN c.source_id IS NOT NULL THEN
        CASE WHEN s.source_id IS NULL THEN 'new' WHEN NOT s.active THEN 'reopened'
             WHEN c.content_hash = s.content_hash THEN 'unchanged' ELSE 'changed' END
      WHEN s.active AND s.source_id IN (SELECT source_id FROM c) THEN 'expired' END AS status
  FROM c FULL JOIN s ON c.source_id = s.source_id AND c.source_job_id = s.source_job_id)"""
_LOG_SOURCE = "'src' || CAST(user_id % 20 AS VARCHAR) || '#' || " + _TYPE.format("user_id")
_LOG = f"""
v_log AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, ts AS observed_at, event_id,
    {_LOG_SOURCE} AS source_id, CAST(user_id AS VARCHAR) AS source_job_id,
    {_LOG_SOURCE} || '#' || CAST(user_id AS VARCHAR) AS internal_id, {STATUS_OF_EVENT} AS status
  FROM events)"""
SQL_LOG = f"WITH {_LOG}"
SQL_LOG_AND_ALL = SQL_DIFF + "," + _LOG
SQL_RESPONSES = f"""WITH v_resp AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, ts AS fetched_at, 'src' || CAST(user_id % 20 AS VARCHAR) AS company_id,
    {_TYPE.format("(user_id * 100)")} AS source_type, event_id AS page_seq,
    CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 404 WHEN event_id % 3 = 1 THEN 500 END AS http_status,
    CASE WHEN event_type = 'error' AND event_id % 3 = 2 THEN 'Request timeout' END AS error
  FROM events),
v_err AS (
  SELECT *, company_id || '#' || source_type AS source_id,
    COALESCE(error, CASE WHEN http_status <> 200 THEN 'HTTP error: ' || CAST(http_status AS VARCHAR) ||
      CASE WHEN source_type = 'workday' AND http_status IN (404, 422) THEN
        ' -- ''Careers'' is likely the wrong site id for tenant ''acme''; check the path in the public careers URL' ELSE '' END
    END) AS message
  FROM v_resp)"""
