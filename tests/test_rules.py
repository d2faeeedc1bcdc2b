import random

from pyspark.sql import functions as F

from postledger.functions.predicates import SearchRule, matching_rules
from postledger.operators import rules

PATTERNS = "name string, nationwide boolean, kind string, pattern string"


def random_rules(rng, n):
    pieces = ["data", "eng", "ops", "qa", "x", "é", "senior d", "a", "", ".net", "c++"]
    places = ["Austin", "Buda", ", TX", "St. Louis", "a.b", "Köln"]
    return [SearchRule(f"r{k:03d}", rng.random() < 0.5, tuple(rng.sample(places, rng.randint(0, 2))), tuple(rng.sample(pieces, rng.randint(0, 3))),
                       tuple(rng.sample(pieces[:6], rng.randint(0, 1)))) for k in range(n)]


def test_many_rules_tag_as_single_expressions_do(spark):
    rng = random.Random(8)
    chosen = random_rules(rng, 60)
    rows = [(r.name, r.nationwide, kind, p) for r in chosen for kind, ps in (("include", r.include_titles), ("exclude", r.exclude_titles), ("location", r.locations)) for p in ps]
    titles = ["Senior Data Engineer", "QA", "ops é", "C++ dev", ".NET", "", None, "DATA", "nothing", "a senior d"]
    spots = ["Austin, TX", "Budapest", "Buda", "AUSTIN", "St. Louis", "axb", "a.b", None, "", "köln"]
    posted = [(f"p{k}", rng.choice(titles), rng.choice(spots)) for k in range(200)]
    df = spark.createDataFrame(posted, "internal_id string, title string, location string").repartition(3)
    patterns = spark.createDataFrame(rows, PATTERNS)
    want = {r.internal_id: sorted(r.tags) for r in df.select("internal_id", matching_rules(chosen, F.col("title"), F.col("location")).alias("tags")).collect()}
    got = {r.internal_id: list(r.rules) for r in rules.tag_postings(df, patterns).collect()}
    assert got == want and sum(map(len, got.values())) > 100
    assert rules.tag_postings(df, patterns.limit(0)).filter(F.size("rules") > 0).count() == 0
    assert rules.tag_postings(df.limit(0), patterns).count() == 0


def test_no_loop_over_rules_and_few_candidates(spark):
    words = spark.range(400).select(F.format_string("word%03dx", "id").alias("word"))
    texts = spark.range(400).select(F.format_string("a word%03dx b", "id").alias("text"))
    out = rules.containing(texts, words)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 400


def test_rules_alike_are_met_once(spark, monkeypatch):
    """Many rules of the same words are one rule to the texts, and lists of names are made once each."""
    rows = [(f"r{k:03d}", False, kind, p) for k in range(300) for kind, p in (("include", "data"), ("exclude", "qa"), ("location", "Austin"))]
    rows += [("far", False, "include", "data"), ("far", False, "location", "Buda"), (None, True, "include", "data"), ("far", False, "include", "data")]
    patterns = spark.createDataFrame(rows, PATTERNS)
    posted = spark.createDataFrame([(k, t, "Austin, TX") for k, t in enumerate(["data eng", "Data", "data qa", None] * 3)], "internal_id long, title string, location string")
    written, cut = [], rules.cut_lineage
    monkeypatch.setattr(rules, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = {r.internal_id: (r.n, r.last) for r in rules.tag_postings(posted, patterns, columns={"n": F.size("rules"), "last": F.array_max("rules")}).collect()}
    assert got == {k: (300, "r299") if k % 4 < 2 else (0, None) for k in range(12)}
    # no table that is made of texts and rules together has a row for each rule
    assert max(t.count() for t in written if "title" in t.columns) < 50
