import datetime as dt
import json

from pyspark.sql import functions as F

from postledger.functions.predicates import LocationFilter
from postledger.operators import diff as D
from postledger.operators import rollups, validate
from postledger.plans import daily, pages
from postledger.schemas import COMPANY_CONFIG, LANDING, WATCH_CONFIG
from postledger.sinks.state import StateStore
from postledger.sources.landing import judged, unreadable_responses
from postledger.sources.registry import no_watches, read_registry, read_watches
from postledger.sources.union import quarantine, union_sources

T0 = dt.datetime(2024, 5, 1, 12)


def response(company, kind, body, page_kind="board", status=200, error=None, seq=0, term=None, path=None, key=None, options=None):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return ("r", T0, company, kind, key or "https://acme.wd5.myworkdayjobs.com/Careers", page_kind, seq, term, 0, path, None, status, error, options, text)


def landing(spark, rows):
    return spark.createDataFrame(rows, LANDING)


def board(*jobs):
    return {"jobs": [{"id": i, "title": t, "location": {"name": place}, "absolute_url": f"https://x/{i}"} for i, t, place in jobs]}


def registry(spark, *entries):
    rows = [(c, None, None, None, [], [], None, None, None, None, None,
             [(k, None, None, "tok", "name", None, "t", None, "s", [], [], None) for k in kinds]) for c, *kinds in entries]
    return read_registry(spark.createDataFrame(rows, COMPANY_CONFIG))


def run(spark, store, rows, run_id, day, root, **kwargs):
    companies, sources = registry(spark, ("acme", "greenhouse", "workday"), ("beta", "lever"))
    return daily.collect(landing(spark, rows), companies, sources, store, run_id, T0 + dt.timedelta(days=day), log_root=f"{root}/log", **kwargs)


def statuses(out):
    return {r.source_job_id: r.status for r in out["diff"].collect()}


def test_life_of_postings(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    where = LocationFilter(("Austin",))
    first = [response("acme", "greenhouse", board((1, "Dev", "Austin"), (2, "QA", "Austin"), (3, "Ops", "Paris"))),
             response("beta", "lever", [{"id": "L", "text": "Cook", "categories": {"location": "Austin"}}])]
    out = run(spark, store, first, "d1", 0, tmp_path, where=where)
    assert statuses(out) == {"1": "new", "2": "new", "L": "new"}
    assert tuple(out["filter_effect"].first()) == (3, 1)
    # counted while the postings were written, not by another scan of them
    assert "parquet" not in out["filter_effect"]._jdf.queryExecution().executedPlan().toString().lower()
    # the same input again: nothing moves
    out = run(spark, store, first, "d2", 1, tmp_path, where=where)
    assert set(statuses(out).values()) == {"unchanged"}
    # one changed, one gone, and a failed source keeps its posting
    third = [response("acme", "greenhouse", board((1, "Senior Dev", "Austin"))), response("beta", "lever", None, status=503)]
    out = run(spark, store, third, "d3", 2, tmp_path, where=where)
    assert statuses(out) == {"1": "changed", "2": "expired"}
    assert tuple(out["stats"].first()) == (3, 1, 1, 0, 1, 1)
    errors = {r.source_id: r.error for r in out["source_errors"].collect()}
    assert errors == {"beta#lever": "HTTP error: 503"}
    # a repeated run changes nothing
    assert statuses(run(spark, store, third, "d3", 2, tmp_path, where=where)) == {"1": "changed", "2": "expired"}
    assert store.version() == 3
    out = run(spark, store, first, "d4", 3, tmp_path, where=where)
    assert statuses(out) == {"1": "changed", "2": "reopened", "L": "unchanged"}
    state = {r.source_job_id: r for r in store.load().collect()}
    assert all(r.active for r in state.values())
    assert state["2"].first_seen_at == T0 and state["2"].last_seen_at == T0 + dt.timedelta(days=3)
    assert state["1"].last_changed_at == T0 + dt.timedelta(days=3)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 + 3 + 2 + 3 and log.select("observation_id").distinct().count() == 11
    newest = D.latest_observation(log).select("internal_id", "status").collect()
    assert {r.internal_id: r.status for r in newest}["acme#greenhouse#2"] == "reopened"
    # a dry run stores nothing
    run(spark, store, third, "d5", 4, tmp_path, where=where, write=False)
    assert store.version() == 4


def test_short_search_expires_nothing(spark, tmp_path):
    def search(total, *paths):
        found = {"total": total, "jobPostings": [{"title": p, "externalPath": f"/job/Austin/{p}_JR{i}", "locationsText": "Austin"} for i, p in enumerate(paths)]}
        return [response("acme", "workday", found, "search", term="")]

    for gate, want in ((True, {"JR0": "unchanged"}), (False, {"JR0": "unchanged", "JR1": "expired"})):
        store = StateStore(spark, str(tmp_path / f"s{gate}"))
        run(spark, store, search(2, "a", "b"), "w1", 0, tmp_path / str(gate))
        assert statuses(run(spark, store, search(2, "a"), "w2", 1, tmp_path / str(gate), gate_incomplete=gate)) == want


def test_identity_and_place_ignore_details(spark):
    found = {"total": 1, "jobPostings": [{"title": "Role", "externalPath": "/job/AUSTIN-TX/Role_R_00043560", "locationsText": "AUSTIN, TX", "bulletFields": ["Spotlight Job"]}]}
    info = {"jobPostingInfo": {"jobReqId": "OTHER", "title": "Role", "location": "UT MAIN CAMPUS", "startDate": "2026-07-28", "jobDescription": "<p>x</p>"}}
    search = response("acme", "workday", found, "search")
    detail = response("acme", "workday", info, "detail", path="/job/AUSTIN-TX/Role_R_00043560")
    failed = response("acme", "workday", None, "detail", status=500, path="/job/AUSTIN-TX/Role_R_00043560")
    rows = [union_sources(landing(spark, x)).first() for x in ([search], [search, detail], [search, failed])]
    assert {(r.source_job_id, r.location) for r in rows} == {("R_00043560", "AUSTIN, TX")}
    assert rows[1].date_posted == dt.datetime(2026, 7, 28) and rows[1].description_text == "x" and rows[0].description_text == ""


def test_one_bad_row_or_source_leaves_the_rest(spark):
    rows = [response("acme", "greenhouse", {"jobs": [{"title": "no id"}, {"id": 7, "title": "ok"}]}), response("beta", "lever", {"data": []}),
            response("acme", "ashby", "not json"), response("beta", "greenhouse", [1, 2])]
    assert [r.source_job_id for r in union_sources(landing(spark, rows)).collect()] == ["7"]
    assert [r.reject_reason for r in quarantine(landing(spark, rows)).collect()] == ["missing id"]


def test_ashby_listing_and_pay(spark):
    jobs = [{"id": "a", "title": "A", "isListed": False}, {"id": "b", "title": "B", "location": "Austin", "secondaryLocations": [{"location": "Dallas"}, "Remote"],
            "compensation": {"min": 120000, "max": 150000}}, {"id": "c", "title": "C", "compensation": {}, "isRemote": True}]
    got = {r.source_job_id: r for r in union_sources(landing(spark, [response("x", "ashby", {"jobs": jobs})])).collect()}
    assert set(got) == {"b", "c"}
    assert got["b"].location == "Austin, Dallas, Remote" and got["b"].salary_text == "$120,000 - $150,000 year" and got["b"].salary_min == 120000.0
    assert got["c"].remote_status == "remote" and got["c"].salary_text == "" and got["c"].location == "Remote"


def test_embedded_postings(spark):
    blocks = [{"@graph": [{"@type": "JobPosting", "title": "G", "url": "https://x/g"}, {"@type": "WebSite"}]},
              [{"@type": ["JobPosting"], "title": "L", "identifier": {"value": "v"}, "jobLocation": [{"address": {"addressLocality": "Austin", "addressRegion": "TX", "addressCountry": "US"}}, {}]}],
              {"@type": "JobPosting", "title": "", "url": "u"}, {"@type": "JobPosting", "title": "S", "identifier": "s", "hiringOrganization": "Org", "employmentType": "PART_TIME"},
              {"@type": "JobPosting", "title": "bad", "employmentType": ["A"]}]
    html = "<script type='application/ld+json'>{oops</script>" + "".join(f'<script type="application/ld+json">{json.dumps(b)}</script>' for b in blocks)
    page = [response("x", "jsonld", html, "html")]
    got = {r.title: r for r in union_sources(landing(spark, page)).collect()}
    assert set(got) == {"G", "L", "S"}
    assert got["L"].source_job_id == "v" and got["L"].location == "Austin, TX" and got["S"].company_name == "Org" and got["S"].employment_type == "part_time"
    assert [r.title for r in quarantine(landing(spark, page)).collect()] == ["bad"]


def test_reports_and_messages(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    jobs = board(*[(i, f"Job {i}", "Austin, TX" if i % 2 else "Paris") for i in range(1, 8)])
    jobs["jobs"][0]["content"] = "line\nEND JOB\nmore"
    out = run(spark, store, [response("acme", "greenhouse", jobs)], "d1", 0, tmp_path)
    postings = daily.postings_of_run(store)
    daily.publish(postings, spark.createDataFrame([], "id string, name string, url string, status string, added_text string, keywords_found array<string>, last_changed_at timestamp_ntz, error string"),
                  out["stats"], out["source_errors"], T0, str(tmp_path / "out"))
    text = "\n".join(r.value for f in sorted((tmp_path / "out" / "latest_report").glob("part-*")) for r in spark.read.text(str(f)).collect())
    assert text.startswith("# Job Collection Report") and "## New Austin-Area Technical Jobs (4)" in text and "## Other New Jobs (3)" in text
    assert (tmp_path / "out" / "archive" / "dt=2024-05-01").exists()
    parts = sorted((tmp_path / "out" / "messages" / "part=1").glob("part-*"))
    body = "\n".join(r.value for f in parts for r in spark.read.text(str(f)).collect())
    ids, inside = [], None
    for line in body.split("\n"):  # a reader of the records
        if line == "JOB":
            inside = {}
        elif line == "END JOB":
            ids.append(inside["id"])
            inside = None
        elif inside is not None and ": " in line:
            k, v = line.split(": ", 1)
            inside.setdefault(k, v)
    assert sorted(ids) == [f"acme#greenhouse|{i}" for i in range(1, 8)]
    assert "records_included: 7" in body and "records_omitted" not in body and "END_JOB" in body
    written = spark.read.json(str(tmp_path / "out" / "latest_jobs" / "jobs"))
    assert written.filter("status = 'new'").count() == 7 == written.count()
    assert spark.read.json(str(tmp_path / "out" / "latest_jobs" / "run")).first()["run"]["status"] == "success"
    dated = spark.read.parquet(str(tmp_path / "out" / "archive")).orderBy("section_ord", "row_ord", "sort_key").collect()
    assert "\n".join(r.line for r in dated) == text


def test_message_limits_are_counted(spark):
    from postledger.operators import feed
    from postledger.workload.views import all_postings

    postings = all_postings(spark, "/root/testdata/sf0.001").cache()
    none = spark.createDataFrame([], "id string, name string, url string, status string, added_text string, keywords_found array<string>, last_changed_at timestamp_ntz, error string")
    offered = postings.filter("status in ('new', 'changed')").count()
    capped = feed.message_bodies(feed.single_message(postings, none, F.lit(T0), max_jobs=4)).first().body
    assert f"records_included: 4\nrecords_omitted: {offered - 4} (record cap;" in capped
    tight = feed.message_bodies(feed.single_message(postings, none, F.lit(T0), max_bytes=500)).first().body
    assert f"records_included: 1\nrecords_omitted: {offered - 1} (body size limit;" in tight
    part = feed.message_bodies(feed.batch_messages(postings, none, F.lit(T0), "all", max_parts=2, max_bytes=20_000)).collect()
    parts = feed.message_bodies(feed.batch_messages(postings, none, F.lit(T0), "all", max_bytes=20_000)).collect()
    left = postings.count() - sum(p.records for p in part)
    assert len(part) == 2 and len(parts) > 2 and left > 0
    assert all(f"part: {p.part} of {len(parts)}\n" in p.body and f"records_omitted: {left} (part limit;" in p.body for p in part)
    assert sum(p.records for p in parts) == postings.count()
    assert all(f"part: {p.part} of {len(parts)}\n" in p.body and len(p.body.encode()) <= 20_000 for p in parts)
    postings.unpersist()


def watch_pages(spark, html, status=200, day=0):
    return spark.createDataFrame([("eta", "ETA", "https://e/", "https://e/", status, None, html, T0 + dt.timedelta(days=day))],
                                 "id string, name string, url string, final_url string, http_status int, error string, html string, checked_at timestamp_ntz")


def test_watched_page_over_time(spark, tmp_path):
    watches = read_watches(spark.createDataFrame([("eta", None, "https://e/", ["Accepting Applications", "deadline"], None, None), ("off", None, "u", None, False, None)], WATCH_CONFIG))
    assert watches.count() == 1 and no_watches(spark).count() == 0
    closed = "<p>Applications closed for this cycle.</p>"
    steps = [(closed, 200, "new"), (closed, 200, "unchanged"), (closed + "<b>Visitors: 1</b>", 200, "unchanged"), (closed + "<b>Visitors: 1</b>", 200, "unchanged"),
             ("<h1>404 Page</h1>", 200, "error"), (None, 503, "error"),
             (closed + "<b>Visitors: 1</b><p>We are now accepting applications. The deadline is 1 October.</p>", 200, "changed")]
    store = StateStore(spark, str(tmp_path / "w"))
    for day, (html, status, want) in enumerate(steps):
        r = pages.check_watches(watch_pages(spark, html, status, day), watches, store, f"c{day}").first()
        assert r.status == want, day
    assert r.keywords_found == ["Accepting Applications", "deadline"] and r.added_text.startswith("We are now accepting")
    kept = store.load().first()
    assert kept.last_changed_at == T0 + dt.timedelta(days=6) and kept.first_seen_at == T0 and kept.last_error == ""


def test_first_check_failing_makes_the_next_one_a_change(spark, tmp_path):
    watches = read_watches(spark.createDataFrame([("eta", "ETA", "https://e/", [], True, 30)], WATCH_CONFIG))
    store = StateStore(spark, str(tmp_path / "w"))
    pages.check_watches(watch_pages(spark, None, 503), watches, store, "a")
    page = "<p>Applications open today, and they close next month.</p>"
    assert pages.check_watches(watch_pages(spark, page, day=1), watches, store, "b").first().status == "changed"


def test_registry_checks(spark):
    source = lambda **k: tuple(k.get(n) for n in ("type", "enabled", "timeout_seconds", "board_token", "board_name", "site_url", "tenant", "wd_host", "site", "tags", "location_overrides", "parsing_config"))
    rows = [("a", "A", None, None, None, None, None, None, None, None, None, [source(type="workday"), source(type="odd")]),
            ("", "B", None, None, None, None, None, None, None, None, None, []),
            ("c", "C", None, None, None, None, None, None, None, None, None, [source(type="greenhouse", board_token="t")])]
    raw = spark.createDataFrame(rows, COMPANY_CONFIG)
    got = sorted(r.error for r in validate.registry_errors(raw).collect())
    assert got == ["Company  has no sources", "Company a: workday source needs tenant + site (or a site_url to derive them from)",
                   "Company missing ID: B", "Unknown source type: odd"]
    assert [r.error for r in validate.registry_errors(raw.limit(0)).collect()] == ["No companies configured"]


def test_failure_streaks(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [("s", "1", day(1), "success", None), ("s", "2", day(2), "error", "x"), ("s", "3", day(3), "error", "y"), ("ok", "1", day(1), "error", "z"), ("ok", "2", day(2), "success", None), ("bad", "1", day(1), "error", "q")]
    h = {r.source_id: r for r in rollups.source_health(spark.createDataFrame(rows, "source_id string, run_id string, finished_at timestamp_ntz, status string, error string")).collect()}
    assert (h["s"].consecutive_failures, h["s"].last_error, h["s"].last_successful_at) == (2, "y", day(1))
    assert (h["ok"].consecutive_failures, h["ok"].last_error, h["ok"].last_status) == (0, None, "success")
    assert (h["bad"].consecutive_failures, h["bad"].last_successful_at) == (1, None)


def search(total, *paths, term="", ord=0, status=200, seq=0):
    found = {"total": total, "jobPostings": [{"title": p, "externalPath": f"/job/Austin/{p}_JR-{p}", "locationsText": "Austin"} for p in paths]}
    row = list(response("acme", "workday", found if status == 200 else None, "search", status, seq=seq, term=term))
    row[8] = ord
    return tuple(row)


def test_a_failed_term_expires_nothing(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    both = [search(1, "a", term="a"), search(1, "b", term="b", ord=1)]
    assert set(statuses(run(spark, store, both, "w1", 0, tmp_path)).values()) == {"new"}
    half = [search(1, "a", term="a"), search(0, term="b", ord=1, status=503)]
    out = run(spark, store, half, "w2", 1, tmp_path)
    assert statuses(out) == {"/job/Austin/a_JR-a": "unchanged"} and {r.status for r in out["source_runs"].collect()} == {"error"}
    # a failed detail page does not keep the source from expiring
    gone = [search(1, "a", term="a"), response("acme", "workday", None, "detail", 500, path="/job/Austin/a_JR-a")]
    assert statuses(run(spark, store, gone, "w3", 2, tmp_path)) == {"/job/Austin/a_JR-a": "unchanged", "/job/Austin/b_JR-b": "expired"}


def test_unreadable_successes_expire_nothing(spark, tmp_path):
    """A search page or a board of another shape, served with status 200, is no empty result."""
    search = lambda term, path: response("acme", "workday", {"total": 1, "jobPostings": [
        {"title": term, "externalPath": f"/job/Austin/{path}", "locationsText": "Austin"}]}, "search", term=term)
    lever = response("beta", "lever", [{"id": "L", "text": "Cook", "categories": {"location": "Austin"}}])
    store = StateStore(spark, str(tmp_path / "state"))
    first = run(spark, store, [search("a", "A_R-1"), search("b", "B_R-2"), lever], "d1", 0, tmp_path)
    assert sorted(statuses(first)) == ["L", "R-1", "R-2"] and first["unreadable"].count() == 0
    busy = response("acme", "workday", "<html>busy</html>", "search", term="b")
    other = response("beta", "lever", {"ok": False, "jobs": []})
    out = run(spark, store, [search("a", "A_R-1"), busy, other], "d2", 1, tmp_path)
    assert {k: v for k, v in statuses(out).items() if v} == {"R-1": "unchanged"}
    runs = {r.source_id: r for r in out["source_runs"].collect()}
    assert runs["acme#workday"].status == "error" and runs["acme#workday"].error == "unreadable response: body is not JSON"
    assert runs["beta#lever"].status == "error" and runs["beta#lever"].error == "unreadable response: body is not an array"
    kinds = sorted((r.kind, r.subject) for r in out["warnings"].collect())
    assert ("unreadable response", "acme#workday") in kinds and ("unreadable response", "beta#lever") in kinds
    assert out["stats"].first().failed_sources == 2
    # without the gate the run is taken at its word
    out = run(spark, StateStore(spark, str(tmp_path / "state")), [search("a", "A_R-1"), busy], "d3", 2, tmp_path, gate_incomplete=False)
    assert statuses(out)["R-2"] == "expired"


def test_what_makes_a_body_unreadable(spark):
    cut = json.dumps(board((1, "Dev", "Austin")))[:-4]
    rows = [response("a", "greenhouse", "\n " + json.dumps(board((1, "Dev", "Austin"))), seq=0), response("a", "greenhouse", cut, seq=1),
            response("a", "greenhouse", " \t\n", seq=2), response("a", "greenhouse", "[]", seq=3), response("a", "greenhouse", None, seq=4),
            response("a", "greenhouse", "down", status=503, seq=5), response("a", "ashby", "null", seq=6), response("a", "lever", "[]", seq=7),
            response("a", "jsonld", "<html>", "html", seq=8), response("a", "workday", "{", "detail", seq=9, path="/job/x"),
            response("a", "greenhouse", '{"jobs": []}', seq=10)]
    df = landing(spark, rows)
    got = {r.page_seq: r.reject_reason for r in unreadable_responses(df).collect()}
    assert got == {1: "body is not JSON", 2: "empty body", 3: "body is not an object", 6: "body is not an object", 9: "body is not JSON"}
    assert unreadable_responses(judged(df)).count() == 5
    # an unreadable detail page fails no source, and what is readable is decoded
    assert sorted(r.page_seq for r in rollups.response_errors(df).collect()) == [1, 2, 3, 5, 6]
    assert [r.title for r in union_sources(df.filter("page_seq in (0, 2, 3, 4, 10)")).collect()] == ["Dev"]


def test_inventory_has_every_active_posting(spark, tmp_path):
    from postledger.operators import feed

    store = StateStore(spark, str(tmp_path / "s"))
    lever = [{"id": "L", "text": "Cook", "categories": {"location": "Austin"}}]
    run(spark, store, [response("acme", "greenhouse", board((1, "Dev", "A"), (2, "QA", "A"))), response("beta", "lever", lever)], "d1", 0, tmp_path)
    run(spark, store, [response("acme", "greenhouse", board((1, "Dev", "A"))), response("beta", "lever", None, status=503)], "d2", 1, tmp_path)
    whole = daily.inventory(store)
    assert {r.internal_id.replace("|", "#") for r in feed.feed_records(whole, "all").collect()} == {"acme#greenhouse#1", "beta#lever#L"}
    assert feed.feed_records(whole, "delta").count() == 0
    none = spark.createDataFrame([], "id string, name string, url string, status string, added_text string, keywords_found array<string>, last_changed_at timestamp_ntz, error string")
    body = feed.message_bodies(feed.batch_messages(whole, none, F.lit(T0), "all")).first().body
    assert "total_active: 2\nnew: 0\nchanged: 0\nexpired: 1\n" in body and "records_included: 2" in body


def test_landed_pages_and_details_are_all_used(spark):
    from postledger.sources import workday

    pages_of = [search(1200, *[f"p{k}x{i}" for i in range(20)], seq=k) for k in range(60)]
    rows = landing(spark, pages_of + [response("acme", "workday", {"jobPostingInfo": {"jobDescription": "<p>d</p>"}}, "detail", path=f"/job/Austin/p{k}x{i}_JR-p{k}x{i}")
                                      for k in range(60) for i in range(20)])
    decoded = union_sources(rows)
    assert decoded.count() == 1200 and decoded.filter("description_text = 'd'").count() == 1200
    plan = workday.search_plan(rows).first()
    assert (plan.total, plan.pages, plan.left_out) == (1200, 50, 200)
    assert workday.search_completeness(rows).filter("found < total").count() == 0


def test_options_come_from_the_registry(spark, tmp_path):
    from postledger.sources.landing import attach_options

    row = response("acme", "workday", {"total": 1, "jobPostings": [{"title": "T", "externalPath": "/job/X/T_JR1"}]}, "search", options={"store_raw": "no", "kept": "yes"})
    source = ("acme", "workday", {"store_raw": "true"}, "ten", "wd9", None)
    sources = spark.createDataFrame([source], "company_id string, type string, parsing_config map<string,string>, tenant string, wd_host string, site string")
    out = attach_options(landing(spark, [row]), sources).first().options
    assert out == {"store_raw": "true", "kept": "yes", "tenant": "ten", "wd_host": "wd9"}


def test_daily_extras(spark, tmp_path):
    store, registry_store = StateStore(spark, str(tmp_path / "s")), StateStore(spark, str(tmp_path / "r"))
    rows = [response("acme", "greenhouse", {"jobs": [{"title": "no id"}, {"id": 7, "title": "ok"}]}), search(3, "a", term="t")]
    out = run(spark, store, rows, "d1", 0, tmp_path, registry=registry_store)
    assert sorted(r.kind for r in out["warnings"].collect()) == ["rejected row", "short search"]
    log = out["run_log"].first()
    assert (log.run_id, log.new_count, log.source_count) == ("d1", 2, 3)
    assert sorted(r.id for r in registry_store.load().collect()) == ["acme", "beta"]
    run(spark, store, rows, "d1", 0, tmp_path, registry=registry_store)
    assert registry_store.version() == 1


def test_landing_is_read_by_partition(spark, tmp_path):
    from postledger.sources import boards
    from postledger.sources.landing import read_landing

    rows = [response("acme", "greenhouse", board((1, "Dev", "A"))), response("beta", "lever", []), search(1, "a")]
    landing(spark, rows).write.partitionBy("run_id", "source_type", "page_kind").parquet(str(tmp_path / "landing"))
    read = read_landing(spark, str(tmp_path / "landing"), "r")
    assert read.count() == 3 and read_landing(spark, str(tmp_path / "landing"), "other").count() == 0
    decoded = boards.greenhouse_rows(read)
    assert decoded.count() == 1 and len(boards.greenhouse_rows(read).select("source_job_id").inputFiles()) >= 1
    text = decoded._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "run_id" in filters and "source_type" in filters and "page_kind" in filters


def test_registry_outcomes_are_written(spark, tmp_path):
    from postledger.sinks.feed import write_registry

    rows = spark.createDataFrame([("a", "found"), ("b", None)], "company_id string, discovery_result string")
    write_registry(rows, str(tmp_path / "o"))
    assert sorted(map(str, spark.read.json(str(tmp_path / "o")).select("company_id", "discovery_result").collect())) == sorted(map(str, rows.collect()))


def test_json_blocks_of_any_case(spark):
    from postledger.sources.jsonld import has_posting

    html = '<script type="application/LD+json">{"@type": "JobPosting", "title": "x"}</script>'
    df = spark.createDataFrame([(html,), ("<p>ld+json</p>",), (None,)], "html string")
    assert [r[0] for r in df.select(has_posting(F.col("html"))).collect()] == [True, False, False]


def test_shared_folder_is_needed_on_a_cluster():
    import types

    import pytest

    from postledger.session import shared_folder

    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        fake = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId="a"))
        with pytest.raises(ValueError):
            shared_folder(fake)


def test_all_landing_reads_the_texts_once(spark, monkeypatch):
    """Seven responses per posting come from one pass over documents."""
    from postledger.workload import payloads

    made = []
    monkeypatch.setattr(payloads, "posting_base", lambda *a, of=payloads.posting_base: made.append(a) or of(*a))
    rows = payloads._all_landing(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    assert rows.filter("source_type = 'lever'").count() == payloads.lever_landing(spark, "/root/testdata/sf0.001").count()


def test_opening_of_a_body(spark):
    from postledger.sources.landing import _opens

    bodies = ["{", " \t\n\x0b\f\r{}", "\xa0{", "[", " [", "", None, "x{"]
    got = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", _opens("object"), _opens("array")).collect()
    assert [tuple(r)[1:] for r in got] == [
        (True, False), (True, False), (False, False), (False, True), (False, True), (False, False), (None, None), (False, False)]
