"""Queries on snapshots, logs and roll-ups."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import LocationFilter
from ..operators import diff as D
from ..operators import feed
from ..operators import rollups as R
from ..operators import validate as V
from ..operators.skew import salted_join
from .registry import query
from .views import (RUN_AT, SQL_ALL, SQL_DIFF, SQL_LOG, SQL_LOG_AND_ALL, SQL_POST, SQL_RESPONSES, all_postings,
                    current_postings, observation_log, posting_base, previous_state, response_log, table)

PLACES = LocationFilter(include=("AFRICA", "NATION_1", ", AMERICA"), exclude=("NATION_10", "NATION_15"))


def _diff(spark, sf):
    return D.snapshot_diff(current_postings(spark, sf), previous_state(spark, sf))


@query("snapshot_diff", SQL_DIFF + " SELECT internal_id, status, content_hash, previous_hash, seen FROM diff")
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select("internal_id", "status", "content_hash", "previous_hash", "seen")


@query("detect_status", SQL_DIFF + " SELECT internal_id, status FROM diff WHERE seen")
def detect_status(spark, sf):
    out = D.detect_status(current_postings(spark, sf), previous_state(spark, sf))
    return out.select(F.concat_ws("#", "source_id", "source_job_id").alias("internal_id"), "status")


@query("expired_postings", SQL_DIFF + " SELECT source_id, source_job_id FROM diff WHERE status = 'expired'")
def expired_postings(spark, sf):
    return D.detect_expired(current_postings(spark, sf), previous_state(spark, sf))


@query("expired_of_complete_sources", SQL_DIFF + """ SELECT source_id, source_job_id FROM diff
  WHERE status = 'expired' AND source_id NOT IN (SELECT 'src' || CAST(s_suppkey AS VARCHAR) || '#lever' FROM supplier)""")
def expired_of_complete_sources(spark, sf):
    current = current_postings(spark, sf)
    short = table(spark, sf, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string"), F.lit("#lever")).alias("source_id"))
    return D.detect_expired(current, previous_state(spark, sf), D.complete_sources(current, short))


_STATS = """count(*) FILTER (WHERE status = 'new') AS "new", count(*) FILTER (WHERE status = 'changed') AS changed,
  count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'expired') AS expired,
  count(*) FILTER (WHERE status = 'reopened') AS reopened, count(status) AS total"""


@query("run_statistics", SQL_DIFF + f" SELECT {_STATS} FROM diff")
def run_statistics(spark, sf):
    return R.run_statistics(_diff(spark, sf))


@query("merge_state", SQL_DIFF + f""" SELECT internal_id, title, content_hash,
  CASE WHEN was_active IS NULL THEN '{RUN_AT}' ELSE '2024-01-02 00:00:00' END AS first_seen_at,
  CASE WHEN status IS NOT NULL THEN '{RUN_AT}' ELSE '2024-01-31 06:00:00' END AS last_seen_at,
  CASE WHEN seen AND (previous_hash IS NULL OR previous_hash <> content_hash) THEN '{RUN_AT}' ELSE '2024-01-15 00:00:00' END AS last_changed_at,
  CASE WHEN seen THEN true WHEN status = 'expired' THEN false ELSE was_active END AS active,
  CASE WHEN status IS NOT NULL THEN 2 ELSE 1 END AS state_version FROM diff""")
def merge_state(spark, sf):
    out = D.next_state(_diff(spark, sf), F.lit(RUN_AT), 2)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("internal_id", "title", "content_hash", text("first_seen_at"), text("last_seen_at"),
                      text("last_changed_at"), "active", "state_version")


@query("merge_state_texts", SQL_DIFF + """, t AS (SELECT COALESCE(c.source_id, s.source_id) || '#' || COALESCE(c.source_job_id, s.source_job_id) AS internal_id,
    sha256(CASE WHEN c.source_id IS NOT NULL THEN c.description_text ELSE s.description_text END) AS description_digest
    FROM c FULL JOIN s ON c.source_id = s.source_id AND c.source_job_id = s.source_job_id)
  SELECT internal_id, description_digest, status AS last_status FROM t JOIN diff USING (internal_id)""")
def merge_state_texts(spark, sf):
    out = D.next_state(_diff(spark, sf), F.lit(RUN_AT), 2)
    return out.select("internal_id", F.sha2("description_text", 256).alias("description_digest"), "last_status")


_ACTIVE = "(seen OR (was_active AND status IS NULL))"


@query("published_inventory", SQL_DIFF + f" SELECT internal_id FROM diff WHERE {_ACTIVE}")
def published_inventory(spark, sf):
    """What a full inventory publishes after the run: every active posting, touched by the run or not."""
    whole = D.inventory(D.next_state(_diff(spark, sf), F.lit(RUN_AT), 2), 2)
    return feed.feed_records(whole, "all").select("internal_id")


@query("inventory_message_counts", SQL_DIFF + f""" SELECT CAST(count(*) FILTER (WHERE {_ACTIVE}) AS VARCHAR) AS total_active, CAST(count(*) FILTER (WHERE status = 'new') AS VARCHAR) AS "new",
  CAST(count(*) FILTER (WHERE status = 'changed') AS VARCHAR) AS changed, CAST(count(*) FILTER (WHERE status = 'expired') AS VARCHAR) AS expired FROM diff""")
def inventory_message_counts(spark, sf):
    """The counts in the header of a message over the whole snapshot."""
    whole = D.inventory(D.next_state(_diff(spark, sf), F.lit(RUN_AT), 2), 2)
    none = spark.createDataFrame([], "id string, name string, url string, status string, added_text string, keywords_found array<string>, last_changed_at timestamp_ntz, error string")
    rows = feed.single_message(whole, none, F.lit(RUN_AT).cast("timestamp_ntz"))
    value = lambda n: F.regexp_extract("text", f"(?m)^{n}: ([0-9]+)$", 1).alias(n)
    return rows.filter("section = 0").select(*[value(n) for n in ("total_active", "new", "changed", "expired")])


@query("expired_after_partial_failure", SQL_DIFF + "," + SQL_RESPONSES[len("WITH "):] + """, v_last AS (
    SELECT source_id, max(strftime(fetched_at, '%Y-%m-%d %H')) AS run FROM v_err GROUP BY 1)
  SELECT source_id, source_job_id FROM diff WHERE status = 'expired' AND source_id NOT IN (
    SELECT v_err.source_id FROM v_err JOIN v_last ON v_last.source_id = v_err.source_id AND run = strftime(fetched_at, '%Y-%m-%d %H') WHERE message IS NOT NULL)""")
def expired_after_partial_failure(spark, sf):
    """Sources with any failed response in their last run, an hour of the whole log, expire nothing."""
    current = current_postings(spark, sf)
    log = response_log(spark, sf).withColumn("run_id", F.date_format("fetched_at", "yyyy-MM-dd HH"))
    source = ["company_id", "source_type"]
    last = log.groupBy(*source).agg(F.max("run_id").alias("run_id"))
    failed = R.response_errors(salted_join(log, last, [*source, "run_id"], "left_semi", F.col("page_seq")))
    diff = D.snapshot_diff(current, previous_state(spark, sf), D.complete_sources(current, failed))
    return diff.filter("status = 'expired'").select("source_id", "source_job_id")


@query("observations", SQL_DIFF + """ SELECT internal_id, status, content_hash, sha256('run-7|' || internal_id) AS observation_id
  FROM diff WHERE status IS NOT NULL""")
def observations(spark, sf):
    log = D.observations(_diff(spark, sf), F.lit("run-7"), F.lit(RUN_AT))
    return log.select("internal_id", "status", "content_hash", "observation_id")


@query("second_run_is_quiet", SQL_DIFF + """ SELECT CAST(0 AS BIGINT) AS "new", CAST(0 AS BIGINT) AS changed, count(*) AS unchanged,
  CAST(0 AS BIGINT) AS expired, CAST(0 AS BIGINT) AS reopened, count(*) AS total FROM c""")
def second_run_is_quiet(spark, sf):
    state = D.next_state(_diff(spark, sf), F.lit(RUN_AT), 2)
    return R.run_statistics(D.snapshot_diff(current_postings(spark, sf), state))


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY internal_id
  ORDER BY observed_at DESC, event_id DESC) AS n FROM v_log) WHERE n = 1)"""


@query("latest_status", SQL_LOG + f", {_LATEST} SELECT internal_id, status, run_id FROM latest")
def latest_status(spark, sf):
    return D.latest_observation(observation_log(spark, sf)).select("internal_id", "status", "run_id")


@query("recent_postings", SQL_LOG_AND_ALL + f""", {_LATEST} SELECT s.source_id || '#' || s.source_job_id AS internal_id, s.title, l.status
  FROM s JOIN latest l ON l.internal_id = s.source_id || '#' || s.source_job_id WHERE s.active""")
def recent_postings(spark, sf):
    return D.recent_postings(previous_state(spark, sf), observation_log(spark, sf)).select("internal_id", "title", "status")


@query("status_counts", SQL_LOG + " SELECT status, count(*) AS postings FROM v_log GROUP BY status")
def status_counts(spark, sf):
    return R.status_counts(observation_log(spark, sf))


@query("bucket_counts", SQL_ALL + """ SELECT CASE WHEN category IN ('Software development', 'QA and testing') THEN 1
  WHEN category IN ('Electrical trade', 'HVAC trade', 'Construction and general labor') THEN 2
  WHEN location LIKE '%TX%' OR location LIKE '%Texas%' OR location LIKE '%Austin%' THEN 3 ELSE 4 END AS bucket,
  count(*) AS postings FROM v_all WHERE status = 'new' GROUP BY 1""")
def bucket_counts(spark, sf):
    return R.bucket_counts(all_postings(spark, sf))


_KEEP = r"""(regexp_matches(location, '(?i)\bAFRICA\b|\bNATION_1\b|, AMERICA\b')
  AND NOT regexp_matches(location, '(?i)\bNATION_10\b|\bNATION_15\b'))"""


@query("filter_effect", SQL_POST + f""" SELECT count(*) FILTER (WHERE {_KEEP}) AS kept,
  count(*) FILTER (WHERE NOT {_KEEP}) AS dropped FROM v_post""")
def filter_effect(spark, sf):
    return R.filter_effect(posting_base(spark, sf), PLACES.matches(F.col("location")))


@query("postings_per_source", SQL_POST + " SELECT source_id, count(DISTINCT source_job_id) AS postings FROM v_post GROUP BY source_id")
def postings_per_source(spark, sf):
    return R.postings_per_source(all_postings(spark, sf))


@query("last_in_run", SQL_LOG + """ SELECT source_id, source_job_id, run_id, status FROM (SELECT *, row_number() OVER (
  PARTITION BY source_id, source_job_id ORDER BY event_id DESC) AS n FROM v_log) WHERE n = 1""")
def last_in_run(spark, sf):
    log = observation_log(spark, sf).select("source_id", "source_job_id", "run_id", "status")
    return D.last_in_run(log, F.col("run_id"))


@query("source_health", """WITH r AS (SELECT 'user' || CAST(user_id AS VARCHAR) AS source_id, ts, event_id, event_type <> 'error' AS ok,
    props AS error FROM events),
  last_ok AS (SELECT source_id, max(ts) FILTER (WHERE ok) AS t FROM r GROUP BY source_id)
  SELECT r.source_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_attempted_at,
    strftime(max(ts) FILTER (WHERE ok), '%Y-%m-%d %H:%M:%S') AS last_successful_at,
    CASE WHEN arg_max(ok, ts) THEN 'success' ELSE 'error' END AS last_status,
    CASE WHEN NOT arg_max(ok, ts) THEN arg_max(error, ts) END AS last_error,
    count(*) FILTER (WHERE NOT ok AND (t IS NULL OR ts > t)) AS consecutive_failures
  FROM r JOIN last_ok USING (source_id) GROUP BY r.source_id""")
def source_health(spark, sf):
    runs = table(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
        F.col("ts").cast("timestamp_ntz").alias("finished_at"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("props").alias("error"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return R.source_health(runs).select("source_id", text("last_attempted_at"), text("last_successful_at"),
                                        "last_status", "last_error", "consecutive_failures")


@query("source_errors", SQL_RESPONSES + """, d AS (SELECT run_id, source_id, message, min(page_seq) AS p, count(*) AS n FROM v_err
    WHERE message IS NOT NULL GROUP BY ALL)
  SELECT run_id, source_id, string_agg(message, '; ' ORDER BY p, message) AS error, CAST(sum(n) AS BIGINT) AS failed_responses
  FROM d GROUP BY run_id, source_id""")
def source_errors(spark, sf):
    return R.source_errors(response_log(spark, sf)).drop("company_id", "source_type")


def _daily_postings(spark, sf):
    out = all_postings(spark, sf)
    return out.withColumn("run_id", F.date_format("date_posted", "yyyy-MM-dd"))


@query("source_runs", SQL_RESPONSES + ", " + SQL_POST[5:] + """, e AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY run_id, source_id ORDER BY page_seq) AS n FROM v_err WHERE message IS NOT NULL) WHERE n = 1),
  j AS (SELECT strftime(date_posted, '%Y-%m-%d') AS run_id, source_id, count(*) AS job_count FROM v_post GROUP BY ALL),
  g AS (SELECT run_id, source_id, max(http_status) AS http_status FROM v_err GROUP BY ALL)
  SELECT g.run_id, g.source_id, CASE WHEN e.message IS NULL THEN 'success' ELSE 'error' END AS status,
    COALESCE(job_count, 0) AS job_count, e.message AS error,
    CASE WHEN e.message IS NULL THEN g.http_status ELSE COALESCE(e.http_status, 500) END AS http_status
  FROM g LEFT JOIN e ON e.run_id = g.run_id AND e.source_id = g.source_id
    LEFT JOIN j ON j.run_id = g.run_id AND j.source_id = g.source_id""")
def source_runs(spark, sf):
    out = R.source_runs(response_log(spark, sf), _daily_postings(spark, sf))
    return out.select("run_id", "source_id", "status", "job_count", "error", "http_status")


@query("run_log", SQL_DIFF + ", " + SQL_RESPONSES[5:] + f""", runs AS (SELECT run_id, source_id, count(message) AS bad FROM v_err GROUP BY ALL)
  SELECT 'run-7' AS run_id, 'success' AS status, (SELECT count(*) FROM supplier) AS source_count,
    (SELECT count(*) FROM runs WHERE bad = 0) AS successful_sources, (SELECT count(*) FROM runs WHERE bad > 0) AS failed_sources,
    count(*) FILTER (WHERE status = 'new') AS new_count, count(*) FILTER (WHERE status = 'changed') AS changed_count,
    count(*) FILTER (WHERE status = 'expired') AS expired_count, 'reports/latest' AS report_path FROM diff""")
def run_log(spark, sf):
    runs = R.source_runs(response_log(spark, sf), _daily_postings(spark, sf))
    stats = R.collection_stats(table(spark, sf, "supplier"), runs, R.run_statistics(_diff(spark, sf)))
    return R.run_log_row(stats, "run-7", F.lit(RUN_AT), F.lit(RUN_AT), "reports/latest").drop(
        "start_time", "end_time", "delivery_status")


@query("merge_companies", """WITH o AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_custkey % 2 = 0 AS enabled FROM customer WHERE c_custkey % 3 <> 0),
  n AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS name, c_custkey % 5 <> 0 AS enabled FROM customer WHERE c_custkey % 4 <> 0)
  SELECT COALESCE(n.id, o.id) AS id, COALESCE(n.name, o.name) AS name, COALESCE(n.enabled, o.enabled) AS enabled,
    CASE WHEN o.id IS NULL THEN 'high' ELSE 'medium' END AS priority,
    CASE WHEN o.id IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created_on,
    CASE WHEN n.id IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS updated_on FROM n FULL JOIN o ON n.id = o.id""")
def merge_companies(spark, sf):
    c = table(spark, sf, "customer")
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    old = c.filter("c_custkey % 3 <> 0").select(key, F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("enabled"),
                                               F.lit("medium").alias("priority"), day.alias("created_at"), day.alias("updated_at"))
    new = c.filter("c_custkey % 4 <> 0").select(key, F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 5 != 0).alias("enabled"),
                                               F.lit("high").alias("priority"))
    out = D.merge_companies(old, new, F.lit(RUN_AT))
    return out.select("id", "name", "enabled", "priority", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
                      F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


@query("merge_sources", """WITH o AS (SELECT 's' || CAST(c_custkey AS VARCHAR) AS id, c_name AS company_id, 'lever' AS t, 'old' AS k, c_custkey % 2 = 0 AS enabled,
    c_nationkey AS f FROM customer WHERE c_custkey % 3 <> 0),
  n AS (SELECT 's' || CAST(c_custkey AS VARCHAR) AS id, c_name AS company_id, 'ashby' AS t, c_mktsegment AS k FROM customer WHERE c_custkey % 4 <> 0)
  SELECT COALESCE(n.id, o.id) AS source_id, COALESCE(o.company_id, n.company_id) AS company_id, COALESCE(n.t, o.t) AS source_type,
    COALESCE(n.k, o.k) AS source_key, COALESCE(o.enabled, true) AS enabled, o.f AS consecutive_failures FROM n FULL JOIN o ON n.id = o.id""")
def merge_sources(spark, sf):
    c = table(spark, sf, "customer")
    key = F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_id")
    old = c.filter("c_custkey % 3 <> 0").select(key, F.col("c_name").alias("company_id"), F.lit("lever").alias("source_type"),
                                               F.lit("old").alias("source_key"), (F.col("c_custkey") % 2 == 0).alias("enabled"),
                                               F.col("c_nationkey").alias("consecutive_failures"))
    new = c.filter("c_custkey % 4 <> 0").select(key, F.col("c_name").alias("company_id"), F.lit("ashby").alias("source_type"),
                                               F.col("c_mktsegment").alias("source_key"))
    return D.merge_sources(old, new)


@query("state_orphans", SQL_DIFF + """ SELECT source_id || '#' || source_job_id AS internal_id FROM s
  WHERE source_id NOT IN (SELECT 'src' || CAST(s_suppkey AS VARCHAR) || '#lever' FROM supplier)""")
def state_orphans(spark, sf):
    known = table(spark, sf, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string"), F.lit("#lever")).alias("source_id"))
    return V.orphans(previous_state(spark, sf), known).select("internal_id")


@query("repeated_keys", SQL_LOG + """ SELECT 'source_id, source_job_id' AS key, source_id || '#' || source_job_id AS value, count(*) AS "rows"
  FROM v_log GROUP BY ALL HAVING count(*) > 1 UNION ALL
  SELECT 'internal_id', internal_id, count(*) FROM v_log GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(spark, sf):
    return V.repeated_keys(observation_log(spark, sf))


@query("domain_errors", """SELECT 'status' AS "column", event_type AS value, count(*) AS "rows" FROM events GROUP BY 2
  UNION ALL SELECT 'remote_status', 'user' || CAST(user_id % 7 AS VARCHAR), count(*) FROM events GROUP BY 2""")
def domain_errors(spark, sf):
    return V.domain_errors(table(spark, sf, "events").select(
        F.col("event_type").alias("status"), F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("remote_status")))
