"""Queries on watched pages, page classification and configuration."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_text
from ..operators import classify as C
from ..operators import rollups, sequence
from ..operators import validate as V
from ..operators import watch as W
from ..session import cut_lineage
from ..sources import registry as R
from .registry import query
from .scalars import PAGE_TEXT_SQL
from .views import table

# --- checks of every page against an earlier version of it -----------------------------------
_TINY, _LONG = "<p>tiny</p>", "<p>Applications open on Monday and close soon after.</p><p>Apply now</p>"
_KIND = "page_id % 10"


def pages_now(spark, sf) -> DataFrame:
    return changed_pages(table(spark, sf, "pages"))


def changed_pages(pages: DataFrame) -> DataFrame:
    """Check responses: one in ten missing, failed, unchanged or barely changed."""
    k = F.expr(_KIND)
    html = (F.when(k == 1, F.lit("<h1>Page not found</h1>")).when(k == 4, F.concat("html", F.lit(_TINY)))
            .when(k >= 5, F.concat("html", F.lit(_LONG))).otherwise(F.col("html")))
    return pages.select(
        F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("name"),
        "url", F.col("url").alias("final_url"), F.when(k == 2, F.lit(503)).otherwise(F.lit(200)).alias("http_status"),
        F.lit(None).cast("string").alias("error"), html.alias("html"), F.lit("2024-02-01 06:00:00").cast("timestamp_ntz").alias("checked_at"))


def pages_before(spark, sf) -> DataFrame:
    """Stored state: older text for pages 5 to 9 of ten, none for page 3."""
    k = F.expr(_KIND)
    p = table(spark, sf, "pages").filter(f"{_KIND} <> 3")
    old = F.when(k >= 5, F.replace(F.col("html"), F.lit("ou"), F.lit("o"))).otherwise(F.col("html"))
    pages = p.select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), F.lit("old name").alias("name"), "url",
                     F.col("url").alias("final_url"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"),
                     old.alias("html"), F.lit("2024-01-01 06:00:00").cast("timestamp_ntz").alias("checked_at"))
    at = F.col("checked_at")
    return _texts(pages).select(
        "id", "url", "name", "content_hash", "content_text", at.alias("first_seen_at"), at.alias("last_checked_at"), at.alias("last_changed_at"),
        F.lit("new").alias("last_status"), F.lit("").alias("last_error"), F.lit("").alias("last_added_text"))


def _texts(pages: DataFrame) -> DataFrame:
    """Page texts, written once as in the page plan: diff and state both read them."""
    return cut_lineage(W.page_texts(pages))


_OLD_TEXT = PAGE_TEXT_SQL.replace("html", "old_html")
CHECK_SQL = f"""WITH h AS (SELECT page_id, {_KIND} AS k, url,
    CASE WHEN {_KIND} = 1 THEN '<h1>Page not found</h1>' WHEN {_KIND} = 4 THEN html || '{_TINY}' WHEN {_KIND} >= 5 THEN html || '{_LONG}' ELSE html END AS html,
    CASE WHEN {_KIND} >= 5 THEN replace(html, 'ou', 'o') ELSE html END AS old_html FROM pages),
  t AS (SELECT page_id, k, url, 'w' || page_id AS id, {PAGE_TEXT_SQL} AS v, {_OLD_TEXT} AS old FROM h),
  cur AS (SELECT id, line, pos, row_number() OVER (PARTITION BY id, line ORDER BY pos) AS n FROM
    (SELECT id, unnest(string_split(v, chr(10))) AS line, generate_subscripts(string_split(v, chr(10)), 1) AS pos FROM t WHERE k NOT IN (1, 2, 3))),
  had AS (SELECT id, line, count(*) AS had FROM (SELECT id, unnest(string_split(old, chr(10))) AS line FROM t) GROUP BY ALL),
  added AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS added FROM cur LEFT JOIN had USING (id, line) WHERE n > COALESCE(had, 0) GROUP BY id),
  o AS (SELECT t.*, added, CASE WHEN k IN (1, 2) THEN 'error' WHEN k = 3 THEN 'new' WHEN v <> old AND length(COALESCE(added, '')) >= 40 THEN 'changed' ELSE 'unchanged' END AS status
    FROM t LEFT JOIN added USING (id))"""
_ERROR = "CASE k WHEN 1 THEN 'page returned 200 but looks like a 404: ' || url WHEN 2 THEN 'HTTP error: 503' ELSE '' END"


def watch_list(spark, sf) -> DataFrame:
    raw = table(spark, sf, "pages").select(
        F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), F.when(F.col("page_id") % 2 == 0, F.lit("Even page")).alias("name"), "url",
        F.array(F.lit("apply now"), F.lit("Deadline"), F.lit("MONDAY")).alias("keywords"),
        F.when(F.col("page_id") % 7 == 0, F.lit(False)).alias("enabled"), F.lit(None).cast("int").alias("timeout_seconds"))
    return R.read_watches(raw)


@query("watch_diff", CHECK_SQL + f" SELECT id, status, CASE WHEN status = 'changed' THEN sha256(added) ELSE sha256('') END AS added_digest, {_ERROR} AS error FROM o")
def watch_diff(spark, sf):
    d = W.watch_diff(_texts(pages_now(spark, sf)), pages_before(spark, sf))
    return d.select("id", "status", F.sha2("added_text", 256).alias("added_digest"), F.coalesce("check_error", F.lit("")).alias("error"))


@query("added_lines", CHECK_SQL + " SELECT id, sha256(added) AS digest FROM added")
def added_lines(spark, sf):
    now = _texts(pages_now(spark, sf)).filter("content_text is not null").select("id", "content_text")
    before = pages_before(spark, sf).select("id", F.col("content_text").alias("previous_text"))
    return W.added_lines(now.join(before, "id")).select("id", F.sha2("added_text", 256).alias("digest"))


# lines of every page against a version with its first two lines at the end and some lines reworded
_ORDER_SQL = f"""WITH RECURSIVE t AS (SELECT page_id, string_split({PAGE_TEXT_SQL}, chr(10)) AS now FROM pages),
  o AS (SELECT page_id, now, list_transform(now[3:] || now[1:2], lambda x: CASE WHEN page_id % 10 >= 5 THEN replace(x, 'ou', 'o') ELSE x END) AS old FROM t),
  b AS (SELECT page_id, unnest(now) AS line, generate_subscripts(now, 1) - 1 AS j FROM o),
  a AS (SELECT page_id, unnest(old) AS line, generate_subscripts(old, 1) - 1 AS i FROM o),
  e AS (SELECT page_id, i, j, i - row_number() OVER (PARTITION BY page_id, i - j ORDER BY i) AS run FROM a JOIN b USING (page_id, line)),
  runs AS (SELECT page_id, i, j, row_number() OVER (PARTITION BY page_id, i - j, run ORDER BY i DESC) AS r FROM e),
  rec AS (
    SELECT page_id, 0 AS alo, len(old) AS ahi, 0 AS blo, len(now) AS bhi, false AS block FROM o
    UNION ALL
    SELECT x.page_id, u.alo, u.ahi, u.blo, u.bhi, u.block FROM (
      SELECT s.page_id, s.alo, s.ahi, s.blo, s.bhi, q.i, q.j, least(q.r, s.ahi - q.i, s.bhi - q.j) AS k,
        row_number() OVER (PARTITION BY s.page_id, s.alo, s.ahi, s.blo, s.bhi ORDER BY least(q.r, s.ahi - q.i, s.bhi - q.j) DESC, q.i, q.j) AS n
      FROM rec s JOIN runs q ON q.page_id = s.page_id AND q.i >= s.alo AND q.i < s.ahi AND q.j >= s.blo AND q.j < s.bhi WHERE NOT s.block) x,
      LATERAL (VALUES (x.i, x.i + x.k, x.j, x.j + x.k, true), (x.alo, x.i, x.blo, x.j, false), (x.i + x.k, x.ahi, x.j + x.k, x.bhi, false)) u(alo, ahi, blo, bhi, block)
    WHERE x.n = 1)
  SELECT 'w' || page_id AS id, sha256(string_agg(line, chr(10) ORDER BY j)) AS digest FROM b
  WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.block AND rec.page_id = b.page_id AND b.j >= rec.blo AND b.j < rec.bhi) GROUP BY page_id"""


@query("added_lines_in_order", _ORDER_SQL)
def added_lines_in_order(spark, sf):
    """Lines of each page outside the blocks it shares in order with an earlier version; moved lines are added ones.

    The SQL leaves out the rule for frequent lines of texts of 200 lines and more, as no given page is that long.
    """
    now = table(spark, sf, "pages").select("page_id", extract_text(F.col("html")).alias("content_text"))
    lines = F.split("content_text", "\n")
    moved = F.concat(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), F.slice(lines, 1, 2))
    old = F.transform(moved, lambda x: F.when(F.expr(_KIND) >= 5, F.replace(x, F.lit("ou"), F.lit("o"))).otherwise(x))
    pairs = cut_lineage(now.select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), "content_text", F.array_join(old, "\n").alias("previous_text")))
    return sequence.added_lines_in_order(pairs).select("id", F.sha2("added_text", 256).alias("digest"))


@query("watch_results", CHECK_SQL + f""" SELECT id, status, CASE WHEN status = 'changed' THEN 'apply now, MONDAY' ELSE '' END AS keywords,
    CASE WHEN status = 'error' THEN NULL WHEN status IN ('new', 'changed') THEN '2024-02-01' ELSE '2024-01-01' END AS changed_on, {_ERROR} AS error FROM o""")
def watch_results(spark, sf):
    d = W.watch_diff(_texts(pages_now(spark, sf)), pages_before(spark, sf))
    keys = table(spark, sf, "pages").select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"),
                                           F.array(F.lit("apply now"), F.lit("Deadline"), F.lit("MONDAY")).alias("keywords"))
    return W.watch_results(d, keys).select("id", "status", F.array_join("keywords_found", ", ").alias("keywords"),
                                           F.date_format("last_changed_at", "yyyy-MM-dd").alias("changed_on"), "error")


@query("merge_watches", CHECK_SQL + f""" SELECT id, CASE WHEN status = 'new' OR (k > 3 AND v <> old) THEN 'Page ' || page_id ELSE 'old name' END AS name,
    sha256(CASE WHEN k IN (1, 2) THEN old ELSE v END) AS content_hash, CASE WHEN k = 3 THEN '2024-02-01' ELSE '2024-01-01' END AS first_seen, '2024-02-01' AS checked,
    CASE WHEN status IN ('new', 'changed') THEN '2024-02-01' ELSE '2024-01-01' END AS changed, status AS last_status, {_ERROR} AS last_error,
    CASE WHEN status = 'changed' THEN length(added) ELSE 0 END AS added_chars FROM o""")
def merge_watches(spark, sf):
    before = pages_before(spark, sf)
    d = W.watch_diff(_texts(pages_now(spark, sf)), before)
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return W.next_watch_state(d, before).select(
        "id", "name", "content_hash", day("first_seen_at", "first_seen"), day("last_checked_at", "checked"), day("last_changed_at", "changed"),
        "last_status", "last_error", F.length("last_added_text").cast("long").alias("added_chars"))


@query("watch_counts", CHECK_SQL + " SELECT count(*) AS watches_checked, count(*) FILTER (WHERE status = 'changed') AS watches_changed FROM o")
def watch_counts(spark, sf):
    return rollups.watch_counts(W.watch_diff(_texts(pages_now(spark, sf)), pages_before(spark, sf)))


@query("watch_feed_state", CHECK_SQL + f""" SELECT id, CASE WHEN page_id % 2 = 0 THEN 'Even page' ELSE id END AS name, CASE WHEN status IN ('changed', 'error') THEN status ELSE 'unchanged' END AS status,
    CASE WHEN status = 'changed' THEN 'apply now, MONDAY' ELSE '' END AS keywords, {_ERROR} AS error FROM o WHERE page_id % 7 <> 0""")
def watch_feed_state(spark, sf):
    before = pages_before(spark, sf)
    state = W.next_watch_state(W.watch_diff(_texts(pages_now(spark, sf)), before), before)
    return W.watch_feed_state(watch_list(spark, sf), state).select("id", "name", "status", F.array_join("keywords_found", ", ").alias("keywords"), "error")


# --- classification -----------------------------------------------------------------------------
# page_id % 16 -> (given address, final address, added html, http status); null keeps the page's own
_MARKS = (
    (1, "https://boards.greenhouse.io/acme/x", None, None), (2, None, "https://boards.greenhouse.io/beta", None),
    (3, None, None, "<script>greenhouse.io board_token: 'gamma'</script>"), (4, None, None, "<a href=\"https://boards.greenhouse.io/delta\">x</a>"),
    (5, None, "https://jobs.lever.co/eps", None), (6, None, None, "<a href='https://jobs.lever.co/zeta/1'>x</a>"), (7, None, "https://jobs.ashby.co/eta", None),
    (8, None, None, "<iframe src=\"https://jobs.ashby.co/theta\">"), (9, None, "https://acme.wd1.myworkdayjobs.com/Careers", None),
    (10, None, None, "<script type=\"application/ld+json\">{\"@type\": \"JobPosting\", \"title\": \"x\"}</script>"),
    (11, None, None, "<script type=\"application/ld+json\">[{\"@type\": \"Organization\"}]</script>"), (12, None, None, "<a href='https://clever.co/no'>x</a>"),
)


def careers_pages(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 16

    def pick(i, default):
        out = default
        for mark in _MARKS:
            if mark[i] is not None:
                out = F.when(k == mark[0], F.lit(mark[i])).otherwise(out)
        return out

    # one address per page, so that reports can join on it
    own = F.concat("url", F.lit("&id="), F.col("page_id").cast("string"))
    given = F.when(k == 1, F.concat(F.lit(_MARKS[0][1] + "?id="), F.col("page_id").cast("string"))).otherwise(own)
    return p.select(F.col("page_id").alias("id"), given.alias("url"), pick(2, own).alias("final_url"),
                    F.concat("html", pick(3, F.lit(""))).alias("html"), F.when(k == 15, F.lit(404)).otherwise(F.lit(200)).alias("http_status"))


_FOUND_SQL = """WITH f AS (SELECT page_id AS id, page_id % 16 AS k, url || '&id=' || page_id AS own FROM pages),
  found AS (SELECT id, k, CASE WHEN k = 1 THEN 'https://boards.greenhouse.io/acme/x?id=' || id ELSE own END AS url,
    CASE WHEN k = 15 THEN NULL WHEN k <= 4 AND k >= 1 THEN 'greenhouse' WHEN k IN (5, 6) THEN 'lever' WHEN k IN (7, 8) THEN 'ashby' WHEN k = 9 THEN 'workday' ELSE 'jsonld' END AS source_type,
    CASE k WHEN 1 THEN 'acme' WHEN 2 THEN 'beta' WHEN 3 THEN 'gamma' WHEN 4 THEN 'delta' WHEN 5 THEN 'eps' WHEN 6 THEN 'zeta' WHEN 7 THEN 'eta' WHEN 8 THEN 'theta'
      WHEN 9 THEN 'https://acme.wd1.myworkdayjobs.com/Careers' WHEN 15 THEN NULL ELSE own END AS identifier,
    CAST(CASE k WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.75 WHEN 5 THEN 0.95 WHEN 6 THEN 0.8 WHEN 7 THEN 0.95 WHEN 8 THEN 0.8 WHEN 9 THEN 0.5 WHEN 10 THEN 0.9 WHEN 15 THEN NULL ELSE 0.3 END AS DOUBLE) AS confidence
  FROM f)"""


@query("classify_pages", _FOUND_SQL + " SELECT id, source_type, identifier, confidence FROM found")
def classify_pages(spark, sf):
    return C.classify_pages(careers_pages(spark, sf)).select("id", "found.source_type", "found.identifier", "found.confidence")


_PROBES_SQL = """p AS (SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workday' ELSE 'jsonld' END AS source_type,
    page_id % 3 = 0 AND page_id % 11 <> 0 AS accessible FROM pages)"""


def probes(spark, sf) -> DataFrame:
    k, full = F.col("page_id") % 5, F.col("page_id") % 3 == 0
    body = (F.when(k == 1, F.when(full, F.lit('[{"id": 1}]')).otherwise(F.lit("[]")))
            .when(k == 3, F.when(full, F.lit('{"jobPostings": [{}]}')).otherwise(F.lit('{"jobPostings": []}')))
            .when(k == 4, F.when(full, F.lit(_MARKS[9][3])).otherwise(F.lit(_MARKS[10][3])))
            .otherwise(F.when(full, F.lit('{"jobs": [{"id": 1}]}')).otherwise(F.lit("{}"))))
    kind = F.expr("CASE page_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workday' ELSE 'jsonld' END")
    return table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("company_id"), kind.alias("source_type"), body.alias("body"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("page_id") % 11 == 0, F.lit(403)).otherwise(F.lit(200)).alias("http_status"))


@query("probe_outcome", f"WITH {_PROBES_SQL} SELECT CAST(id AS VARCHAR) AS company_id, source_type, accessible FROM p")
def probe_outcome(spark, sf):
    return C.probe_outcome(probes(spark, sf))


_REPORT_SQL = f"""{_FOUND_SQL}, {_PROBES_SQL},
  r AS (SELECT f.id, CASE WHEN f.id % 13 = 0 THEN 'no_url' WHEN f.source_type IS NULL THEN 'detection_failed' WHEN COALESCE(accessible, false) THEN 'success' ELSE 'no_access' END AS discovery_result,
    CASE WHEN f.id % 13 <> 0 THEN f.source_type END AS source_type, CASE WHEN f.id % 13 <> 0 AND f.source_type NOT IN ('jsonld', 'workday') THEN identifier END AS board,
    CASE WHEN f.id % 13 <> 0 AND f.source_type IN ('jsonld', 'workday') THEN identifier END AS site_url,
    CASE WHEN f.id % 13 <> 0 AND f.source_type IS NOT NULL THEN COALESCE(accessible, false) END AS enabled
  FROM found f LEFT JOIN p ON p.id = f.id AND p.source_type = f.source_type)"""


def _outcomes(spark, sf):
    pages = careers_pages(spark, sf)
    companies = pages.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Company "), F.col("id").cast("string")).alias("name"),
                             F.when(F.col("id") % 13 != 0, F.col("url")).alias("career_page_url"))
    return C.discovery_report(companies, C.classify_pages(pages), C.probe_outcome(probes(spark, sf)))


@query("discovery_report", _REPORT_SQL + " SELECT CAST(id AS VARCHAR) AS id, discovery_result, source_type, board, site_url, enabled FROM r")
def discovery_report(spark, sf):
    return _outcomes(spark, sf).select("id", "discovery_result", "source_type", "board", "site_url", "enabled")


@query("discovery_counts", _REPORT_SQL + " SELECT discovery_result, count(*) AS companies FROM r GROUP BY 1")
def discovery_counts(spark, sf):
    return rollups.discovery_counts(_outcomes(spark, sf))


# --- configuration ----------------------------------------------------------------------------------
def company_config(spark, sf) -> DataFrame:
    """Configured companies from customers, with typical mistakes."""
    k = F.col("c_custkey")
    kind = F.expr("CASE c_custkey % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'jsonld' WHEN 4 THEN 'workday' WHEN 5 THEN 'workday' ELSE 'taleo' END")
    key = F.when(k % 3 != 0, F.col("c_name"))
    source = F.struct(
        kind.alias("type"), F.when(k % 5 == 0, F.lit(False)).alias("enabled"), F.lit(None).cast("int").alias("timeout_seconds"),
        F.when(k % 7 == 0, key).alias("board_token"), F.when((k % 7).isin(1, 2), key).alias("board_name"), F.when((k % 7).isin(3, 4), key).alias("site_url"),
        F.when(k % 7 == 5, key).alias("tenant"), F.lit(None).cast("string").alias("wd_host"), F.when(k % 7 == 5, F.lit("Careers")).alias("site"))
    rows = table(spark, sf, "customer").select(
        F.when(k % 50 != 9, F.concat(F.lit("c"), k.cast("string"))).otherwise(F.lit("")).alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"),
        F.when(k % 4 == 0, F.lit(False)).alias("enabled"), F.when(k % 6 == 0, F.lit("high")).alias("priority"), F.when(k % 20 != 3, F.array(source)).alias("sources"))
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (
        ("id", ""), ("name", ""), ("enabled", ""), ("priority", ""), ("categories", "array<string>"), ("locations", "array<string>"),
        ("career_page_url", "string"), ("careers_url", "string"), ("notes", "string"), ("manual_review", "boolean"))], F.transform(
        "sources", lambda s: s.withField("parsing_config", F.lit(None).cast("map<string,string>"))).alias("sources"))


_CONFIG_SQL = """WITH c AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 50 <> 9 THEN 'c' || c_custkey ELSE '' END AS id,
    CASE c_custkey % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'jsonld' WHEN 4 THEN 'workday' WHEN 5 THEN 'workday' ELSE 'taleo' END AS t,
    c_custkey % 20 <> 3 AS has FROM customer)"""


@query("registry_errors", _CONFIG_SQL + """ SELECT id AS company_id, 'Company missing ID: ' || CASE WHEN k % 2 = 0 THEN c_name ELSE id END AS error FROM c WHERE id = ''
  UNION ALL SELECT id, 'Company ' || id || ' has no sources' FROM c WHERE NOT has
  UNION ALL SELECT id, 'Unknown source type: taleo' FROM c WHERE has AND t = 'taleo'
  UNION ALL SELECT id, 'Company ' || id || ': workday source needs tenant + site (or a site_url to derive them from)' FROM c WHERE has AND t = 'workday' AND k % 3 = 0
  UNION ALL SELECT id, 'Company ' || id || ': ' || t || ' source is missing ' || CASE t WHEN 'greenhouse' THEN 'board_token' WHEN 'jsonld' THEN 'site_url' ELSE 'board_name' END
    FROM c WHERE has AND t IN ('greenhouse', 'lever', 'ashby', 'jsonld') AND k % 3 = 0""")
def registry_errors(spark, sf):
    return V.registry_errors(company_config(spark, sf))


@query("registry", _CONFIG_SQL + """ SELECT id AS company_id, CASE WHEN k % 2 = 0 THEN c_name ELSE id END AS name, CASE WHEN k % 6 = 0 THEN 'high' ELSE 'medium' END AS priority,
  t AS type, k % 5 <> 0 AS enabled, 30 AS timeout_seconds, id || '#' || t AS source_id FROM c WHERE has AND id <> ''""")
def registry(spark, sf):
    companies, sources = R.read_registry(company_config(spark, sf).filter("id <> ''"))
    return companies.select(F.col("id").alias("company_id"), "name", "priority").join(
        sources.select("company_id", "type", "enabled", "timeout_seconds", "source_id"), "company_id")


@query("enabled_sources", _CONFIG_SQL + " SELECT id AS company_id, t AS type FROM c WHERE has AND id <> '' AND k % 4 <> 0 AND k % 5 <> 0 AND t = 'lever'")
def enabled_sources(spark, sf):
    companies, sources = R.read_registry(company_config(spark, sf).filter("id <> ''"))
    return R.enabled_sources(companies, sources, source_type="lever").select("company_id", "type")


@query("watch_list", "SELECT 'w' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'Even page' ELSE 'w' || page_id END AS name, url, 30 AS timeout_seconds FROM pages WHERE page_id % 7 <> 0")
def watch_list_query(spark, sf):
    return watch_list(spark, sf).drop("keywords")


@query("rule_patterns", """SELECT p_brand || p_partkey AS name, p_partkey % 2 = 0 AS nationwide, 'include' AS kind, p_name AS pattern FROM part
  UNION ALL SELECT p_brand || p_partkey, p_partkey % 2 = 0, 'exclude', p_type FROM part WHERE p_partkey % 3 = 0""")
def rule_patterns(spark, sf):
    k = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        F.concat("p_brand", k.cast("string")).alias("name"), F.when(k % 2 == 0, F.lit(True)).alias("nationwide"),
        F.lit(None).cast("array<string>").alias("locations"), F.array("p_name").alias("include_titles"),
        F.when(k % 3 == 0, F.array("p_type")).alias("exclude_titles"))
    return R.rule_patterns(raw)


