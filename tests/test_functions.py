import datetime as dt
import html
import random
import uuid

import pytest
from pyspark.sql import functions as F

from postledger.functions import dates, html as H, predicates, records, rules, similarity, text


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_titles(spark):
    cases = {
        "Senior Software Engineer": "senior software engineer", "  Software   Engineer  ": "software engineer",
        "Software Engineer (URGENT)": "software engineer", "Software Engineer - NEW": "software engineer",
        "a (b) c (d)": "a", "x - newcastle": "x", "a (b) c": "a (b) c", "Dev Ops": "dev ops", "": "",
    }
    assert column(spark, cases, text.normalize_title) == list(cases.values())


def test_places(spark):
    cases = {"San Francisco, CA": "san francisco, ca", "San Francisco, CA, USA": "san francisco, ca",
             "San Francisco (Bay Area), CA": "san francisco, ca", "Austin ,  us ": "austin", "Usa": "usa"}
    assert column(spark, cases, text.normalize_location) == list(cases.values())


def test_company(spark):
    assert column(spark, ["  Google   Inc.  "], text.normalize_company) == ["google inc."]


def test_unescape_equals_the_standard_library(spark):
    rnd = random.Random(4)
    parts = ["&amp;", "&lt;", "&", "&#", "&#x", "&#65;", "&#x41", "&#128;", "&#0;", "&#13;", "&notit;", "&not", "&notin;", "&AMP",
             "&#1114112;", "&#xD800;", "&#99999999999999;", "&#xfdd0;", "&#x1F600;", "&#65534;", "abc", " ", "\n", ";", "é", "&bogus;",
             "&CounterClockwiseContourIntegral;", "&#11;", "&hearts", "&sup1", "&frac12;x", "&#000000000065;", "&&", "1", "#"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    assert column(spark, texts, H.html_unescape) == [html.unescape(t) for t in texts]


def test_descriptions_are_decoded_before_tags_go(spark):
    assert column(spark, ["&lt;p&gt;Hi &amp;amp; you&lt;/p&gt;&lt;br&gt; &lt;b&gt;x&lt;/b&gt;", "<p>a</p>\n\n <p> b &mdash; c</p>"],
                  H.clean_html) == ["Hi &amp; you\nx", "a\nb — c"]


def test_page_text_hides_scripts_and_decodes_last(spark):
    page = ("<head><style>.a{color:red}</style><SCRIPT>var n='abc';</SCRIPT><!-- x --></head><svg><path/></svg>"
            "<h1>Program</h1><p>Closed &lt;soon&gt;.</p>")
    assert column(spark, [page], H.extract_text) == ["Program\nClosed <soon>."]


def test_truncation(spark):
    s = "First sentence here now. " + "x" * 20
    assert one(spark, "v string", (s,), text.truncate_text(F.col("v"), 28)) == "First sentence here now."
    assert one(spark, "v string", ("y" * 50,), text.truncate_text(F.col("v"), 10)) == "yyyyyyy..."
    assert one(spark, "v string", ("short.",), text.truncate_text(F.col("v"), 10)) == "short."
    assert one(spark, "v string", ("a." + "b" * 50,), text.truncate_text(F.col("v"), 10)) == "a.bbbbb..."


def test_hash_parts_cannot_hide_nulls(spark):
    df = spark.createDataFrame([("a", None, "c"), ("a", "c", None)], "x string, y string, z string")
    h = text.content_hash(F.col("x"), F.col("y"), F.col("z"), F.lit("d"), F.lit("u"))
    assert df.select(h).distinct().count() == 2


def test_uuid(spark):
    urls = ["https://example.com/1", "x", "é"]
    assert column(spark, urls, text.uuid5_url) == [str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u in urls]


def test_terminators(spark):
    assert column(spark, ["a\n end job \nb", "END JOBS", "x\nEND JOB"], lambda c: text.escape_terminator(c, "END JOB")) == [
        "a\nEND_JOB\nb", "END JOBS", "x\nEND_JOB"]


@pytest.mark.parametrize("raw,want", [
    ("2024-01-02T10:00:00-05:00", dt.datetime(2024, 1, 2, 10)), ("2024-01-02T10:00:00.123456Z", dt.datetime(2024, 1, 2, 10, 0, 0, 123456)),
    ("2024-01-02", dt.datetime(2024, 1, 2)), ("20240102", dt.datetime(2024, 1, 2)), ("2024-01-02 10:00", dt.datetime(2024, 1, 2, 10)),
    ("2024-01-02T10:00+0530", dt.datetime(2024, 1, 2, 10)), ("2024", None), ("2024-13-01", None), ("yesterday", None), ("", None),
])
def test_iso_dates_keep_the_wall_clock(spark, raw, want):
    assert one(spark, "v string", (raw,), dates.parse_iso(F.lit(None), F.col("v"))) == want


def test_week_dates_as_the_standard_library_reads_them(spark):
    raws = [f"{y}-W{w:02d}{d}" for y in (1999, 2004, 2009, 2015, 2020, 2021, 2024) for w in (0, 1, 9, 26, 52, 53, 54) for d in ("", "-0", "-1", "-4", "-7", "-8", "3")]
    raws += ["2024W053", "2024W05", "2024W5", "2024-W053", "2024W05-3", "2024-W05-3T10:11:12", "2024W053T10:11Z", "2024-W05-3 10:11:12+02:00", "0000-W01-1", "2024-W05-"]

    def plain(raw):
        try:
            return dt.datetime.fromisoformat(raw.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            return None

    assert column(spark, raws, dates.parse_iso) == [plain(r) for r in raws]


def test_epoch_millis(spark):
    assert column(spark, ["1677884732296", "x", None, "-1000"], dates.epoch_millis) == [
        dt.datetime(2023, 3, 3, 23, 5, 32, 296000), None, None, dt.datetime(1969, 12, 31, 23, 59, 59)]


def test_relative_dates(spark):
    now = dt.datetime(2026, 8, 2, 12)
    cases = {"Posted Today": 0, "Just posted": 0, "Posted Yesterday": 1, "Posted 5 Days Ago": 5, "Posted 30+ Days Ago": 30,
             "Posted 2 Months Ago": 60, "Posted a while back": None, "": None}
    got = column(spark, cases, lambda c: dates.parse_posted_on(c, F.lit(now)))
    assert got == [None if d is None else now - dt.timedelta(days=d) for d in cases.values()]


AREA = ("Austin", "Buda", "Round Rock", "Georgetown", "Texas", ", TX", "Remote")
ABROAD = ("Germany", "Hungary", "India", "United Kingdom", "Mexico", "Japan")


def test_place_filter(spark):
    keep = ["Austin, TX", "AUSTIN TX", "Round Rock Campus", "Remote, USA", "US, Texas, Austin", "Buda, TX", "Remote California"]
    drop = ["Bangalore, India", "Noida", "Budapest", "Remote (Germany)", "Remote, Mexico", "", None]
    f = predicates.LocationFilter(AREA, ABROAD)
    assert column(spark, keep + drop, f.matches) == [True] * len(keep) + [False] * len(drop)
    off = predicates.LocationFilter(AREA, ABROAD, enabled=False)
    assert column(spark, ["Noida"], off.matches) == [True]
    assert column(spark, ["Noida"], predicates.LocationFilter().matches) == [True]


def test_rules_tag_and_never_drop(spark):
    found = predicates.matching_rules(
        (predicates.SearchRule("qa", True, (), ("qa engineer",), ("senior",)),
         predicates.SearchRule("local", False, ("Austin, TX",), ("help desk",))), F.col("t"), F.col("l"))
    df = spark.createDataFrame([("QA Engineer", "Paris"), ("Senior QA Engineer", "x"), ("Help Desk", "Austin, TX"), ("Help desk", "Paris")], "t string, l string")
    assert [r.v for r in df.select(found.alias("v")).collect()] == [["qa"], [], ["local"], []]


def test_workday_paths(spark):
    paths = ["/job/Austin-Energy/Helper_JR104610", "/job/X/Lead_R-10065705", "/job/AUSTIN-TX/Lead_R_00043560", "/job/Austin/Analyst"]
    assert column(spark, paths, rules.requisition_id) == ["JR104610", "R-10065705", "R_00043560", "/job/Austin/Analyst"]
    assert one(spark, "v string", ("",), rules.requisition_id(F.col("v"), F.lit("R9"))) == "R9"
    place = lambda t, p: one(spark, "t string, p string", (t, p), rules.summary_location(F.col("p"), F.col("t")))
    assert place("2 Locations", "/job/Noida/E_R-1") == "Noida"
    assert place("3 locations", "/job/AUSTIN-TX/A_R-2") == "AUSTIN TX"
    assert place("Austin, TX", "/job/Else/A_R-2") == "Austin, TX"
    assert place("", "") == "Unknown"
    assert place("2 Locations", "odd") == "2 Locations"


def test_workday_types(spark):
    cases = [("Full time", "Helper", "full_time"), ("Part time", "Analyst", "part_time"), ("Contract", "x", "contract"),
             ("Seasonal", "x", "temporary"), ("", "x", "unknown"), ("Full time", "Electrician Apprentice", "apprenticeship")]
    df = spark.createDataFrame(cases, "t string, n string, w string")
    assert df.filter(rules.workday_employment(F.col("t"), F.col("n")) != F.col("w")).count() == 0


def test_scores_meet_thresholds_exactly(spark):
    s = similarity.score(F.lit(True), F.lit(1.0), F.lit(False), F.lit(True), F.lit(False))
    assert one(spark, "v int", (1,), s) == 0.8
    sim = similarity.string_similarity(F.col("a"), F.col("b"))
    assert one(spark, "a string, b string", ("", ""), sim) == 1.0
    assert one(spark, "a string, b string", ("é", "e"), sim) == 0.0


def test_report_groups(spark):
    df = spark.createDataFrame([("QA and testing", "Paris"), ("HVAC trade", "Austin"), ("", "Austin"), ("", "austin"), ("", "Houston, TX")], "c string, l string")
    assert [r.b for r in df.select(records.markdown_bucket(F.col("c"), F.col("l")).alias("b")).collect()] == [1, 2, 3, 4, 3]
