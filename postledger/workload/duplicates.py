"""Queries on duplicate postings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates as D
from .registry import SQL, query
from .views import SQL_ALL, all_postings, current_postings, previous_state, SQL_DIFF

_LEV = "1.0 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))"
# every pair of different sources with its score, by definition
PAIRS_SQL = SQL_ALL + f""", v_key AS (SELECT internal_id, source_id, company_name, lower(title) AS title, lower(location) AS place, apply_url, source_url FROM v_all),
v_pairs AS (SELECT a.internal_id, b.internal_id AS duplicate_id, round(30 + 40 * (CASE WHEN a.title = b.title THEN 1.0 ELSE {_LEV.format('a.title', 'b.title')} END)
    + CASE WHEN a.place = b.place THEN 20 ELSE 0 END
    + CASE WHEN a.apply_url = b.apply_url THEN 10 WHEN a.source_url = b.source_url THEN 9 ELSE 0 END, 6) / 100 AS score
  FROM v_key a JOIN v_key b ON a.company_name = b.company_name AND a.source_id <> b.source_id),
v_dup AS (SELECT * FROM v_pairs WHERE score >= 0.8)"""


def _roles(spark, sf):
    return D.with_role(all_postings(spark, sf))


@query("duplicate_links", SQL_ALL + f""", k AS (SELECT company_name AS c, lower(title) AS t, lower(location) AS p, apply_url AS u, source_url AS v, source_id AS s FROM v_all),
  rol AS (SELECT DISTINCT 'role' AS scope, md5(length(c) || ':' || c || length(t) || ':' || t || length(p) || ':' || p) AS node, c, p, t, 'any' AS via, '' AS url, s FROM k
    UNION SELECT DISTINCT 'role', md5(length(c) || ':' || c || length(t) || ':' || t || length(p) || ':' || p), c, p, t, 'apply_url', u, s FROM k
    UNION SELECT DISTINCT 'role', md5(length(c) || ':' || c || length(t) || ':' || t || length(p) || ':' || p), c, p, t, 'source_url', v, s FROM k
    UNION SELECT DISTINCT 'job', md5(length(c) || ':' || c || length(t) || ':' || t), c, '', t, 'apply_url', u, s FROM k),
  unit AS (SELECT scope, node, c, p, t, via, url, min(s) AS lo, max(s) AS hi FROM rol GROUP BY ALL),
  x AS (SELECT a.scope, a.node AS node_a, b.node AS node_b, a.via, a.url,
      round(30 + 40 * (CASE WHEN a.t = b.t THEN 1.0 ELSE {_LEV.format('a.t', 'b.t')} END) + CASE WHEN a.scope = 'role' THEN 20 ELSE 0 END
        + CASE a.via WHEN 'apply_url' THEN 10 WHEN 'source_url' THEN 9 ELSE 0 END, 6) / 100 AS score
    FROM unit a JOIN unit b ON a.scope = b.scope AND a.via = b.via AND a.url = b.url AND a.c = b.c AND a.p = b.p AND a.node <= b.node
    WHERE least(a.lo, b.lo) <> greatest(a.hi, b.hi))
  SELECT * FROM x WHERE score >= 0.8""")
def duplicate_links(spark, sf):
    return D.duplicate_links(_roles(spark, sf))


@query("best_duplicates", PAIRS_SQL + """ SELECT internal_id, duplicate_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY internal_id ORDER BY score DESC, duplicate_id) AS n FROM v_dup) WHERE n = 1""")
def best_duplicates(spark, sf):
    roles = _roles(spark, sf)
    return D.best_duplicates(roles, D.duplicate_links(roles))


_LOW_SQL = PAIRS_SQL.replace("round(30 + 40", "round(CASE WHEN a.company_name = b.company_name THEN 30 ELSE 0 END + 40").replace(
    "ON a.company_name = b.company_name AND a.source_id <> b.source_id", "ON a.source_id <> b.source_id").replace("score >= 0.8", "score >= 0.6")


@query("best_duplicates_across_companies", _LOW_SQL + """ SELECT internal_id, duplicate_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY internal_id ORDER BY score DESC, duplicate_id) AS n FROM v_dup) WHERE n = 1""")
def best_duplicates_across_companies(spark, sf):
    """Best duplicates from 0.6 on, where company equality is not necessary."""
    roles = _roles(spark, sf)
    return D.best_duplicates(roles, D.duplicate_links(roles, 0.6))


@query("duplicate_groups", PAIRS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
  reach(a, b) AS (SELECT internal_id, duplicate_id FROM v_dup UNION SELECT r.a, d.duplicate_id FROM reach r JOIN v_dup d ON d.internal_id = r.b)
  SELECT d.internal_id, least(g.b, d.internal_id) AS possible_duplicate_group, d.score AS duplicate_confidence
  FROM (SELECT internal_id, max(score) AS score FROM v_dup GROUP BY 1) d JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) g ON g.a = d.internal_id""")
def duplicate_groups(spark, sf):
    roles = _roles(spark, sf)
    return D.duplicate_groups(roles, D.duplicate_links(roles))


@query("duplicate_groups_kept_up_to_date", SQL["duplicate_groups"])
def duplicate_groups_kept_up_to_date(spark, sf):
    """The groups of all postings, from those without one in eleven documents and the changes since."""
    postings = all_postings(spark, sf)
    number = F.col("source_job_id").cast("long")
    before, now = D.with_role(postings.filter(number % 11 != 0)), _roles(spark, sf)
    groups = D.duplicate_groups(before, D.duplicate_links(before))
    arrived = D.with_role(postings.filter((number % 11 == 0)))
    return D.update_groups(groups, now, arrived)


@query("exact_duplicates", """SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS source_id, CAST(user_id AS VARCHAR) || event_type AS source_job_id, count(*) AS copies
  FROM events GROUP BY ALL HAVING count(*) > 1""")
def exact_duplicates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return D.exact_duplicates(e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
                                       F.concat(F.col("user_id").cast("string"), "event_type").alias("source_job_id")))


@query("already_known", SQL_DIFF + " SELECT c.source_id, c.source_job_id FROM c JOIN s ON c.source_id = s.source_id AND c.source_job_id = s.source_job_id")
def already_known(spark, sf):
    out = D.exact_duplicates_of(current_postings(spark, sf), previous_state(spark, sf))
    return out.select("source_id", "source_job_id")


@query("duplicates_of_new", SQL_DIFF + f""", n AS (SELECT source_id || '#' || source_job_id AS id, source_id, company_name, lower(title) AS title, lower(location) AS place, apply_url, source_url
    FROM c WHERE source_id || '#' || source_job_id NOT IN (SELECT source_id || '#' || source_job_id FROM s)),
  e AS (SELECT source_id || '#' || source_job_id AS id, source_id, company_name, lower(title) AS title, lower(location) AS place, apply_url, source_url FROM s),
  q AS (SELECT a.id AS internal_id, b.id AS duplicate_id, round(30 + 40 * (CASE WHEN a.title = b.title THEN 1.0 ELSE {_LEV.format('a.title', 'b.title')} END)
      + CASE WHEN a.place = b.place THEN 20 ELSE 0 END + CASE WHEN a.apply_url = b.apply_url THEN 10 WHEN a.source_url = b.source_url THEN 9 ELSE 0 END, 6) / 100 AS score
    FROM n a JOIN e b ON a.company_name = b.company_name AND a.source_id <> b.source_id)
  SELECT internal_id, duplicate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY internal_id ORDER BY score DESC, duplicate_id) AS rank FROM q WHERE score >= 0.8) WHERE rank = 1""")
def duplicates_of_new(spark, sf):
    """Best known duplicate of each posting that is new in the run."""
    fresh, known = (D.with_role(x) for x in _new_and_known(spark, sf))
    return D.best_duplicates(fresh, D.duplicate_links(fresh.unionByName(known)), known)




def _new_and_known(spark, sf):
    state = previous_state(spark, sf)
    new = current_postings(spark, sf).join(state.select("source_id", "source_job_id"), ["source_id", "source_job_id"], "left_anti")
    return new.withColumn("internal_id", F.concat_ws("#", "source_id", "source_job_id")), state


@query("ranked_duplicates_of_new", SQL["duplicates_of_new"].replace("SELECT internal_id, duplicate_id, score FROM (SELECT *,", "SELECT internal_id, duplicate_id, score, rank FROM (SELECT *,").replace(" WHERE rank = 1", ""))
def ranked_duplicates_of_new(spark, sf):
    """All known duplicates of each posting that is new in the run, best first."""
    return D.duplicates_of(*_new_and_known(spark, sf))


# a third of all postings in one company and place, many of them without links
_HOT = {
    "company_name": "CASE WHEN doc_id % 3 = 0 THEN 'Hot Employer' ELSE company_name END",
    "location": "CASE WHEN doc_id % 3 = 0 THEN 'One Place' ELSE location END",
    "apply_url": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE apply_url END",
    "source_url": "CASE WHEN doc_id % 8 = 0 THEN '' ELSE source_url END",
}
_HOT_SQL = PAIRS_SQL.replace("FROM v_all),", "FROM v_hot),").replace(
    ", v_key AS", ", v_hot AS (SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in _HOT.items()) + ") FROM v_all), v_key AS")


@query("hot_duplicates", _HOT_SQL + """ SELECT internal_id, duplicate_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY internal_id ORDER BY score DESC, duplicate_id) AS n FROM v_dup) WHERE n = 1""")
def hot_duplicates(spark, sf):
    """Best duplicates where one company and place holds a third of all postings and many URLs are blank."""
    roles = D.with_role(all_postings(spark, sf).withColumns({k: F.expr(v) for k, v in _HOT.items()}))
    return D.best_duplicates(roles, D.duplicate_links(roles))
