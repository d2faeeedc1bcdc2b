import random
import re

from pyspark.sql import functions as F

from postledger.operators import duplicates as D


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _sim(a, b):
    return 1.0 if a == b else 1 - _lev(a, b) / max(len(a), len(b))


def _postings(spark, rows):
    return spark.createDataFrame(
        rows, "internal_id string, source_id string, company_name string, title string, location string, "
              "apply_url string, source_url string")


def _random_rows(seed, n):
    rnd = random.Random(seed)
    words = ["data", "senior", "engineer", "analyst", "qa", "tester", "ii", "lead", "ops"]
    rows = []
    for i in range(n):
        title = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.3:
            k = rnd.randrange(len(title))
            title = title[:k] + rnd.choice("xyz") + title[k + 1:]
        hot = rnd.random() < 0.4
        rows.append((
            f"id{i:04d}", f"s{rnd.randrange(3)}", "Acme" if hot else f"C{rnd.randrange(3)}", title,
            "Austin" if hot else rnd.choice(["Austin", "Dallas", "Remote"]),
            f"u{rnd.randrange(12)}", f"v{rnd.randrange(6)}",
        ))
    return rows


def _brute(rows, threshold):
    out = {}
    for p in rows:
        for q in rows:
            if p[1] == q[1]:
                continue
            points = (30 * (p[2].lower() == q[2].lower()) + 40 * _sim(p[3], q[3]) + 20 * (p[4].lower() == q[4].lower())
                      + (10 if p[5] == q[5] else 9 if p[6] == q[6] else 0))
            if round(points, 6) >= round(threshold * 100, 6):
                out[p[0], q[0]] = round(round(points, 6) / 100, 8)
    return out


def test_all_pairs_equal_brute_force(spark):
    for seed, threshold in ((1, 0.8), (2, 0.75), (3, 0.9), (4, 0.7), (5, 0.6), (6, 0.5), (7, 0.45)):
        rows = _random_rows(seed, 160)
        df = _postings(spark, rows)
        got = {(r.internal_id, r.duplicate_id): round(r.score, 8) for r in D.duplicates_of(df, df, threshold).collect()}
        assert got == _brute(rows, threshold)


def test_best_and_groups_equal_brute_force(spark):
    rows = _random_rows(7, 160)
    pairs = _brute(rows, 0.85)
    roles = D.with_role(_postings(spark, rows))
    links = D.duplicate_links(roles, 0.85)
    best = {}
    for (a, b), s in pairs.items():
        best[a] = min(best.get(a, (9, "")), (-s, b))
    got = {r.internal_id: (round(-r.score, 8), r.duplicate_id) for r in D.best_duplicates(roles, links).collect()}
    assert got == best
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {a: (find(a), round(-best[a][0], 8)) for a in best}
    groups = {r.internal_id: (r.possible_duplicate_group, round(r.duplicate_confidence, 8))
              for r in D.duplicate_groups(roles, links).collect()}
    assert groups == want


def test_similar_titles_lossless(spark):
    rnd = random.Random(5)
    titles = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    titles += sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(10, 24))) for _ in range(60)} - set(titles))
    lows = (0.25, 0.5, 0.525, 0.625, 0.7, 0.75, 0.8, 0.9)
    items = spark.createDataFrame([(t, low, t, low, "s", "t") for t in titles for low in lows],
                                  "item string, k double, title string, low double, s_min string, s_max string")
    rows = D.similar_titles(items, ["k"]).collect()
    for low in lows:
        got = {(r.a, r.b) for r in rows if r.k == low}
        want = {(a, b) for a in titles for b in titles if a < b and _sim(a, b) >= low - 1e-9}
        assert got == want, low


def test_candidates_of_close_titles_grow_in_proportion(spark):
    """Titles of one block that share many letters meet only where a segment of one stands in the other."""
    counts = []
    for n in (300, 600, 1200):
        rnd = random.Random(n)
        # n / 3 families of three close titles each; all letters are common
        rows = []
        for k in range(n // 3):
            base = "".join(rnd.choice("abcdefghijklmnopqrstuvw ") for _ in range(24))
            rows += [(f"{k}-{j}", base[:j * 7] + "xyz"[j] + base[j * 7 + 1:], "one", 0.75, "s", "t") for j in range(3)]
        items = spark.createDataFrame(rows, "item string, title string, block string, low double, s_min string, s_max string")
        met = D.segment_candidates(items, ["block"]).distinct().count()
        assert D.similar_titles(items, ["block"]).count() >= n
        counts.append(met)
    assert counts[0] < 3 * 300 and counts[2] < 3 * counts[1] < 9 * counts[0], counts


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.format_string("%04d", "id").alias("u"), F.format_string("%04d", F.col("id") + 1).alias("v"))
    rows = D.connected_components(edges).collect()
    assert len(rows) == 301 and {r.component for r in rows} == {"0000"}


def test_low_threshold_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        D.duplicate_links(D.with_role(_postings(spark, _random_rows(1, 3))), 0.4)


def test_low_thresholds_use_equi_joins(spark):
    """Other companies are met by place, URL or title, never by a loop over all pairs."""
    roles = D.with_role(_postings(spark, _random_rows(9, 120)))
    needed = D._needed_titles(0.7)
    assert needed["spot", "apply_url"] == 1.0 and needed["job", "any"] == 1.0 and ("name", "any") not in needed
    assert not any(scope in ("spot", "name") for scope, _ in D._needed_titles(0.71))
    block = ["place"]
    items = roles.select(F.col("role").alias("item"), "title", "place", F.lit(0.5).alias("low"), F.col("source_id").alias("s_min"), F.col("source_id").alias("s_max"))
    for plan in (D.similar_titles(items, block), D._titles_of_block(items, block)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    rows = _random_rows(11, 120)
    pairs = _brute(rows, 0.6)
    roles = D.with_role(_postings(spark, rows))
    links = D.duplicate_links(roles, 0.6)
    best = {}
    for (a, b), s in pairs.items():
        best[a] = min(best.get(a, (9, "")), (-s, b))
    got = {r.internal_id: (round(-r.score, 8), r.duplicate_id) for r in D.best_duplicates(roles, links).collect()}
    assert got == best
    assert {r.internal_id for r in D.duplicate_groups(roles, links).collect()} == set(best)


def test_exact_duplicates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "source_id string, source_job_id string")
    assert [tuple(r) for r in D.exact_duplicates(df).collect()] == [("a", "1", 2)]
    assert D.exact_duplicates_of(df, df.filter("source_id = 'b'")).count() == 1


def test_roles_do_not_collide(spark):
    rows = [("1", "s1", "a|b", "c", "p"), ("2", "s2", "a", "b|c", "p"), ("3", "s1", "x", None, "y"), ("4", "s2", "x", "y", None)]
    df = spark.createDataFrame([(i, s, c, t, p, None, None) for i, s, c, t, p in rows],
                               "internal_id string, source_id string, company_name string, title string, location string, apply_url string, source_url string")
    roles = D.with_role(df)
    assert roles.select("role").distinct().count() == 4 and roles.select("job").distinct().count() == 4


def test_groups_kept_up_to_date_equal_a_full_run(spark):
    """Arrivals join components, expiries split them, over four runs."""
    rnd = random.Random(21)
    rows = _random_rows(21, 220)
    now = dict((r[0], r) for r in rows[:140])
    roles = D.with_role(_postings(spark, list(now.values())))
    groups = D.duplicate_groups(roles, D.duplicate_links(roles))
    reserve = rows[140:]
    for run in range(4):
        gone = rnd.sample(sorted(now), 6)
        moved = [now.pop(k) for k in gone]
        arrived = [reserve.pop() for _ in range(8)]
        renamed = rnd.choice(sorted(now))
        moved.append(now[renamed])
        arrived.append((*now[renamed][:3], now[renamed][3] + " x", *now[renamed][4:]))
        # one run touches a single company, so that the others are carried over
        if run == 3:
            back = [r for r in moved[:-1] if r[2] != "Acme"]
            now.update((r[0], r) for r in back)
            moved = [r for r in moved if r[2] == "Acme"]
            arrived = [r for r in arrived if r[2] == "Acme"]
        now.update((r[0], r) for r in arrived)
        roles = D.with_role(_postings(spark, list(now.values())))
        groups = D.update_groups(groups, roles, D.with_role(_postings(spark, moved + arrived)))
        full = D.duplicate_groups(roles, D.duplicate_links(roles))
        key = lambda df: sorted((r.internal_id, r.possible_duplicate_group, round(r.duplicate_confidence, 8)) for r in df.collect())
        assert key(groups) == key(full) and key(full)


def test_segments_meet_by_one_number(spark):
    items = spark.createDataFrame(
        [("k", None, 1, "senior data engineer"), ("k", None, 6, "senior data engineers"), ("k", "x", 2, "senior data engineer"), ("k", "x", 3, "senior data engineers"),
         ("k", "y", 4, "senior data engineer ii"), ("k", "y", 5, "senior data engineer i")],
        "c string, p string, item int, title string").selectExpr("*", "0.75D AS low", "'s1' AS s_min", "'s2' AS s_max")
    near = D.similar_titles(items, ["c", "p"])
    plan = D.segment_candidates(items, ["c", "p"])._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Join \[(.*?)\], \[", plan)
    assert len(keys) == 1 and "," not in keys[0] and "_at" in keys[0]
    assert sorted((r.c, r.p, r.a, r.b) for r in near.collect()) == [("k", "x", 2, 3), ("k", "y", 4, 5)]


def test_exploded_sides_are_never_broadcast(spark):
    """Sizes guessed before an explode, or from files with repeated texts, must not bring a side into the driver."""
    roles = D.with_role(_postings(spark, _random_rows(11, 60)))
    links = D.duplicate_links(roles, 0.6)
    items = spark.createDataFrame([("c", "a", "data engineer", 0.75, "s0", "s1"), ("c", "b", "data engineers", 0.75, "s0", "s1")],
                                  "company string, item string, title string, low double, s_min string, s_max string")
    for low in (0.75, 0.25):
        near = D.similar_titles(items.withColumn("low", F.lit(low)), ["company"])
        assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
        assert near.count() == 1
    blocks = D._titles_of_block(items, ["company"])
    assert "BroadcastHashJoin" not in blocks._jdf.queryExecution().executedPlan().toString() and blocks.count() == 1
    best = D.best_duplicates(roles, links)
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()
