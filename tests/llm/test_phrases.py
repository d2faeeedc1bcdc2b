import random
from collections import Counter

import pytest
from conftest import SF
from postledger.llm import phrases


def plain(rows, least, top, share):
    """Collocations by counting every word, pair and triple in plain Python."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else "\n" if c in ".,;:!?\n\x0b\x0c\r" else c for c in text or "")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) == 3 > len(words) and words in (w[:2], w[1:])]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, n, vocabulary=12):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "é", "😀", "x\x1cy", "Z\xa0z", "\x00", "und", "the-end", "c"][:vocabulary]
    gaps = [" ", "  ", "\t", ", ", ".", "\n", " ", " ", " "]
    return [(rng.choice(["en", None, "und", "de"]), "".join(w + rng.choice(gaps) for w in rng.choices(words, k=rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("shard_words", [1, 40, 1 << 21])
@pytest.mark.parametrize("least, share", [(3, 50), (10, 30)])
def test_against_plain_counts(spark, shard_words, least, share):
    rows = random_rows(least, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = rows_of(phrases.collocations(docs, least=least, top=15, share=share, shard_words=shard_words))
    assert got == plain(rows, least, 15, share) and got


def test_index_counts_words_pairs_and_triples():
    import numpy as np

    rng = random.Random(2)
    ids = [rng.choice([0, 1, 2, 3]) for _ in range(300)] + [0]
    index = phrases.Index(phrases.build(np.array(ids, dtype=np.int32)))
    at, x, y, n = index.pairs(np.array([False, True, True, True]))
    want = Counter((a, b) for a, b in zip(ids, ids[1:]) if a and b)
    assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == want
    live = np.zeros(len(index.starts), dtype=bool)
    live[at] = True
    name = {k: (a, b) for k, a, b in zip(at.tolist(), x.tolist(), y.tolist())}
    left, right, n = index.triples(live)
    got = {(*name[a], name[b][1]): c for a, b, c in zip(left.tolist(), right.tolist(), n.tolist())}
    assert got == Counter(t for t in zip(ids, ids[1:], ids[2:]) if all(t))


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r["lang"], r["text"]) for r in docs.collect()], 10, 2000, 50)
    assert rows_of(phrases.collocations(docs, shard_words=20_000)) == want and want


def test_large_counts_stay_exact(spark):
    n = 3_000_000_019
    df = spark.createDataFrame([(n, n + 2, n + 4)], "a long, l long, r long").select(phrases._score("a", "l", "r"))
    assert df.first()[0] == 1000000 * n * n // ((n + 2) * (n + 4))


def test_edges(spark, edge, empty):
    assert rows_of(phrases.collocations(empty)) == []
    want = plain([(r["lang"], r["text"]) for r in edge.collect()], 2, 2000, 50)
    assert rows_of(phrases.collocations(edge, least=2, shard_words=5000)) == want and want


def test_python_gets_and_gives_small_batches(spark):
    import numpy as np

    from postledger.llm.common import BATCHES, ROWS_PER_BATCH, map_rows

    rows = phrases._in_parts([np.arange(50_000)] * 3, ["p", "q", "n"])
    assert rows.num_rows == 50_000 and max(len(c) for c in rows.column("p").chunks) <= phrases._AT_ONCE
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for name, (default, _) in BATCHES.items():
            spark.conf.set(name, default)
        sizes = map_rows(spark.range(30_000, numPartitions=1).toDF("n"), [("n", "long")], lambda batches: ({"n": [len(b[0])]} for b in batches))
        assert max(r.n for r in sizes.collect()) <= ROWS_PER_BATCH
        assert {k: spark.conf.get(k) for k in BATCHES} == {k: small for k, (_, small) in BATCHES.items()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
        map_rows(spark.range(3).toDF("n"), [("n", "long")], lambda batches: ({"n": b[0]} for b in batches)).collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "700"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
