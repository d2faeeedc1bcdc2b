"""Page texts, the classifier and the pipeline."""
import importlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF, edge_rows
from postledger.llm import decontaminate, mixing, nbsvm, pages, sharding, simhash
from postledger.llm.queries import QUERIES

ARTICLE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header><h1>no</h1></header><nav><ul><li><a href=x>no</a></ul></nav><div class="cookie-notice">no</div><main><article class=post>
<header><h1>The &amp; title</h1><p>no</p></header><p>First   <b>bold</b>&nbsp;text<br>second line<p>Unclosed &lt;tag&gt; 5 < 6
<div class="ad-box"><p>no</p></div><ul><li>one<li>two <a href=y>link</a></ul><table><tr><td>c1<td>c2</table><aside>no</aside>
<form>no<input value=no></form><section id="comments"><p>no</p></section><p class="adjective lead">last</p></article></main>
<div>no</div><footer>&copy; no</footer></body></html>"""


def test_marked_articles():
    main = [t for t, z in pages.blocks(ARTICLE) if z == "main"]
    assert main == ["The & title", "First bold text", "second line", "Unclosed <tag> 5 < 6", "one", "two link", "c1", "c2", "last"]
    assert pages.blocks("") == [] and pages.blocks("<p") == [] and pages.blocks("a <b class='x") == [("a", "open")]


def test_names_of_parts():
    def main(html):
        return [t for t, z in pages.blocks(html) if z == "main"]

    assert main('<body class="nav ads"><div class="has-sidebar layout"><main class="with-sidebar"><article class="post no-comments"><p>kept</p></article></main></div>') == ["kept"]
    assert main('<article><div class="entry-header"><h1>Title</h1><span>by</span></div><p class="lead">kept</p><div class="page-sidebar"><h2>no</h2></div></article>') == ["Title", "kept"]
    assert main('<article><p>kept</p><ul class="comment-list"><li>no</li></ul><div id="cookie_banner">no</div></article><article class="comment">no</article>') == ["kept"]
    assert main('<article><p>kept <span class="badge adjective">too</span></p><div role="complementary">no</div><p hidden>no</p></article>') == ["kept too"]


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    menu = "<div>Home News Contact About us Login here</div>"
    tail = "<p>All rights of this fine host are reserved by its owners</p>"
    rows = [(i, f"http://Host.example/{i}", f"<body>{menu}<p>Story{i} about thing{i} and place{i}</p>{tail}") for i in range(6)]
    rows += [(10, "http://host.example/copy", rows[0][2]), (11, "http://other.example/", f"<body>{menu}<p>alone</p>"), (12, None, None), (13, "", "<p>x &gt; y"),
             (None, "http://host.example/9", "<article><p>whole   text\n</p></article>" + tail), (14, "http://host.example/long", "<p>" + "word " * 50_000), (14, "http://host.example/long", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("text", F.lit("x")).withColumn("host", F.lit("x"))
    got = pages.main_text(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert text[i] == f"Story{i} about thing{i} and place{i}"
    assert text[10] == text[0] and text[11] == "Home News Contact About us Login here\nalone"
    assert text[12] == "" and text[13] == "x > y" and text[None] == "whole text" and text[14] == " ".join(["word"] * 50_000)
    assert pages.main_text(df.limit(0)).count() == 0


def test_loose_blocks_of_an_article(spark):
    note = "<div>Please join the friends of this host today and get more</div>"
    rows = [(i, f"http://h.example/{i}", f"<article><h1>Head {i}</h1><p>The same paragraph stands here on every page of it</p>{note}<div>Own words of page number{i}</div></article>")
            for i in range(4)]
    rows += [(9, "http://h.example/9", "<article>Bare text of this one stays<br>in two lines</article>" + note)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"Head {i}\nThe same paragraph stands here on every page of it\nOwn words of page number{i}"
    assert got[9] == "Bare text of this one stays\nin two lines"


def test_paragraphs_of_unmarked_pages_stay_whole(spark):
    """Copies of an article at two urls, and words of another page inside a paragraph."""
    same = "The council voted on Monday to build a bridge over the river before the next summer begins"
    menus = "<ul><li><a href=a>Home</a><li><a href=b>Local news</a><li><a href=c>Sports and weather</a></ul>"
    rows = [(1, "http://h.example/1", f"<body>{menus}<div>{same}</div>"), (2, "http://h.example/2", f"<body><div><a href=x>Other menu</a></div><div>{same}</div>"),
            (3, "http://h.example/3", f"<body>{menus}<div>In a letter the council voted on Monday to build a tower instead</div>"), (4, "http://h.example/4", "<a href=x>Only a link</a>")]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: same, 2: same, 3: "In a letter the council voted on Monday to build a tower instead", 4: "Only a link"}


def test_boilerplate_against_a_plain_suffix_array(spark):
    """Blocks that go are those covered by substrings which a sorted list of all suffixes shows on enough pages."""
    import math
    import random

    rng = random.Random(3)
    shared = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("menu", 9), ("foot", 14), ("tiny", 2), ("rare", 8), ("mid", 6))]
    rows = []
    for p in range(12):
        parts = [shared[0], *[" ".join(rng.choices(["a", "b", "c", "d", "e"], k=rng.randint(2, 14))) for _ in range(rng.randint(1, 4))], shared[1]]
        if p % 2:
            parts.insert(1, shared[2])
        if p < 2:
            parts.insert(2, shared[3])
        if p % 3 == 0:
            parts.insert(2, shared[4] + " and own words")
        rows.append((p, "http://h.example/x", "".join(f"<div>{x}</div>" for x in parts)))
    rows.append((20, "http://h.example/x", rows[0][2]))

    streams = {}
    for p, _, html in rows:
        own = [text.split() for text, _ in pages.blocks(html)]
        streams.setdefault(tuple(map(tuple, own)), []).append(p)
    need = max(3, math.ceil(0.3 * len(streams)))
    order = sorted((tuple(w for b in own for w in b)[i:], n) for n, own in enumerate(streams) for i in range(sum(map(len, own))))
    boiler = set()  # longest common beginnings of `need` neighbours from different pages
    for k, (suffix, _) in enumerate(order):
        for size in range(5, len(suffix) + 1):
            on = {n for other, n in order if other[:size] == suffix[:size]}
            if len(on) < need:
                break
            boiler.add(suffix[:size])
    want = {}
    for own, ids in streams.items():
        words = [w for b in own for w in b]
        gone = {i for b in boiler for s in range(len(words) - len(b) + 1) if tuple(words[s:s + len(b)]) == b for i in range(s, s + len(b))}
        at, kept = 0, []
        for b in own:
            whole = all(i in gone for i in range(at, at + len(b))) or len(b) < 5 and sum(b in other for other in streams) >= need
            if not whole:
                kept.append(" ".join(b))
            at += len(b)
        want.update({p: "\n".join(kept) for p in ids})
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want and any("rare" in t for t in got.values()) and not any("menu" in t or "tiny" in t for t in got.values())


def test_whole_pages_tell_what_a_host_repeats(spark):
    """Pages of equal surroundings are as many as their articles; words in articles count, and stay what they mostly are."""
    note = "<div>Please join the friends of this host today and get more</div>"
    rows = [(i, "http://h.example/x", f"<nav>Home</nav><article><h1>Head {i}</h1><p>Own text of page number{i}</p>{note}</article><footer>All rights reserved</footer>") for i in range(4)]
    rows += [(4, "http://h.example/x", rows[0][2]), (5, "http://h.example/x", f"<body>{note}<div>Only here</div>")]
    line = "We write a letter to all readers every Monday"
    rows += [(10 + i, "http://g.example/x", f"<main><p>Story {i} of this paper</p><p>{line}</p></main>") for i in range(3)]
    rows += [(20, "http://g.example/x", f"<main><p>Last story</p><div>{line}</div></main>"), (30, "http://f.example/x", rows[0][2])]
    rows += [(40 + i, "http://e.example/x", f"<main><p>Story {i} of this paper</p><{t}>{line}</{t}></main>") for i, t in enumerate(("p", "div", "div"))]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(4)] == [f"Head {i}\nOwn text of page number{i}" for i in range(4)] and got[4] == got[0] and got[5] == "Only here"
    assert [got[10 + i] for i in range(3)] == [f"Story {i} of this paper\n{line}" for i in range(3)] and got[20] == f"Last story\n{line}"
    assert [got[40 + i] for i in range(3)] == [f"Story 0 of this paper\n{line}", "Story 1 of this paper", "Story 2 of this paper"]
    assert got[30] == "Head 0\nOwn text of page number0\nPlease join the friends of this host today and get more"


def test_marked_and_unmarked_pages_against_plain_counts(spark, monkeypatch):
    """Fingerprints packed and places returned in small groups leave out nothing that is boilerplate."""
    import math
    import random

    monkeypatch.setattr(pages, "HELD", 60)
    monkeypatch.setattr(pages, "GROUPED", 25)
    rng = random.Random(12)
    common = [" ".join(rng.choices("abcdef", k=k)) for k in (2, 3, 5, 6, 7, 9, 12)]

    def part():
        return rng.choice(common) if rng.random() < 0.5 else " ".join(rng.choices(["a", "b", "c", "\u00e9"], k=rng.randint(1, 9)))

    rows = []
    for p, host in enumerate(["one"] * 30 + ["two"] * 4 + ["", "three"] * 12):
        inner = "".join(f"<{t}>{part()}</{t}>" for t in rng.choices(["p", "div", "h2"], k=rng.randint(0, 4)))
        around = [f"<{t}>{part()}</{t}>" for t in rng.choices(["nav", "div", "p", "footer"], k=2)]
        rows.append((p, f"http://{host}/x" if host else None, around[0] + (f"<article>{inner}</article>" if p % 3 else inner) + around[1]))
    rows += [(100 + p, url, html) for p, url, html in rows[::5]]
    found = {p: (pages.host_of(url), pages.blocks(html)) for p, url, html in rows}
    on, alike = {}, {}
    for host, own in found.values():
        texts = tuple(t for t, _ in own)
        alike.setdefault(host, set()).add(texts)
        words = [(w, z == "main") for t, z in own for w in t.split()]
        places = [(tuple(w for w, _ in words[i:i + 5]), all(z for _, z in words[i:i + 5])) for i in range(len(words) - 4)]
        for x, inside in places + [(t, z == "main") for t, z in own if len(t.split()) < 5]:
            where = on.setdefault((host, x), {})
            where[texts] = where.get(texts, False) or not inside
    want = {}
    for p, (host, own) in found.items():
        need = min(max(3, math.ceil(0.3 * len(alike[host]))), 50)
        words = [w for t, _ in own for w in t.split()]
        boiler = {x for (h, x), where in on.items() if h == host and len(where) >= need and 2 * sum(where.values()) > len(where)}
        covered = {i for s in range(len(words) - 4) if tuple(words[s:s + 5]) in boiler for i in range(s, s + 5)}
        at, left = 0, []
        for text, zone in own:
            n = len(text.split())
            if zone == "main" or not (covered.issuperset(range(at, at + n)) or n < 5 and text in boiler):
                left.append((text, zone))
            at += n
        marked = any(z in ("main", "loose") for _, z in own)
        want[p] = "\n".join(t for t, z in left if z in (("main", "loose") if marked else ("open",)))
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want
    assert sum(len(want[p].split("\n")) < sum(z in ("main", "loose", "open") for _, z in own) for p, (_, own) in found.items()) > 10


def test_suffix_order_of_a_host(spark):
    """Sorted suffixes and what neighbours share, against a sorted list; a stretch goes on over batches and partitions."""
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "ab", "\u00e9", "B"], k=rng.randint(0, 40))) for _ in range(60)] + ["x y z x y z x y z", "x y", "x y"] * 40
    rows = [(i, f"h{i % 2}", t.split(), [t] * (t == "x y")) for i, t in enumerate(texts)]
    read = spark.createDataFrame(rows, "row long, host string, words array<string>, short array<string>").repartition(5)
    want = sorted({(h, s, r) for r, h, w, short in rows for s in [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] + ["\n" + x for x in short]},
                  key=lambda x: (x[0], x[1].encode(), x[2]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = pages.suffix_order(read)
        assert [tuple(r) for r in order.collect()] == want
        got = {(r["host"], r["suffix"]): r["n"] for r in pages.repeats(order).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    counts = {}
    for h, s, _ in want:
        counts[h, s] = counts.get((h, s), 0) + 1
    assert got == {k: n for k, n in counts.items() if n > 1} and got["h0", "\nx y"] == 40


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = np.where(x @ np.array([1.0, -2.0, 0.5, 0.0, 0.0]) > 0, 1.0, -1.0)
    w = nbsvm.dual_coordinate_descent([np.arange(5)] * 300, list(x), y, 5, np.ones(300), epochs=50)
    assert (np.sign(x @ w) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 300
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert held["predicted"][held["quality"] == 1].mean() > 0.99 and held["predicted"][held["quality"] == 0].mean() < 0.15


def test_scores_of_odd_tables(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(None, 1), (12, None), (13, 7)], "doc_id long, quality int")
    got = nbsvm.score(edge, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    none = labels.limit(0)
    assert {r["score"] for r in nbsvm.score(edge, none).collect()} == {0.5}
    assert nbsvm.score(empty, labels).count() == 0
    # labels of held-out rows do not matter
    wrong = labels.withColumn("quality", F.when(nbsvm.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((r["doc_id"] or -1, r["score"]) for r in nbsvm.score(edge, wrong).collect()) == sorted((r["doc_id"] or -1, r["score"]) for r in got)
    assert nbsvm.keep_good(edge, labels).columns == edge.columns


def test_queries_cover_their_tables(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, fn in QUERIES.items():
        count = fn(spark, SF).count()
        if name.startswith("op9"):
            assert count == n["pages"]
        elif name[:5] == "op13_":
            assert count == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        elif name[:5] == "op11_":
            assert count > 100
        elif name[:4] not in ("op4_", "op5_"):
            assert count == n["documents"], name


def test_pipeline_against_plain_python(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in nbsvm.score(docs, labels).collect() if r["predicted"]}
    left = sorted(good)
    def shingled(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingled(rows[d]["text"]) for d in left]
    parent = {}
    for d in left:
        parent[d] = d
    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(left[i]), find(left[j])))
                parent[b] = a
    left = [d for d in left if find(d) == d]
    memo, bad = {}, set()
    items = [decontaminate.word_hashes(r["text"], memo) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d in left:
        w = decontaminate.word_hashes(rows[d]["text"], memo)
        for it in items:
            same = it[:, None] == w[None, :]
            for g in range(-len(it) + 1, len(w)):
                line = np.diagonal(same, g)
                if line.sum() >= 9:
                    i, j = decontaminate.best_stretch(line, decontaminate.SIMILARITY)
                    if j > i and j - i >= min(decontaminate.MIN_WORDS, len(it)):
                        bad.add(d)
    left = [d for d in left if d not in bad]
    kept = docs.filter(F.col("doc_id").isin(left))
    want = sorted(r["doc_id"] for r in mixing.mix(kept).collect())
    got = pipeline.run(spark, SF).toPandas()
    assert sorted(got["doc_id"]) == want and bad
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() <= max(got.groupby("text_crc32")["size"].sum().max(), sums.sum() / 40 * 1.2)
    assert got.columns.tolist() == sharding.shard_documents(docs).columns
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    docs2 = docs.withColumn("score", F.lit("x"))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs2, SF).columns == docs2.columns, name


def test_pipeline_of_odd_tables(spark, edge, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names pass through all stages."""
    pipeline = importlib.import_module("corpus_pipeline")
    good = spark.createDataFrame([(i, 1) for i in range(10, 60)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "nothing of this"), (2, None), (3, "")], "item_id long, text string")
    for name, docs in (("odd", edge), ("none", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        good.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = pipeline.run(spark, f"{tmp_path}/odd").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect() if r["doc_id"] is not None}
    assert got and all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 for r in got if r["doc_id"] is not None)
    # of the empty texts 1 to 3 and of the copies 5 and 6 one is left
    ids = {r["doc_id"] for r in got}
    assert not ids & {2, 3, 6}
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = edge
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert docs.columns == edge.columns
