"""Quality rules, token counts, mixing and sharding against plain Python."""
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA, edge_rows
from postledger.llm import mixing, quality, sharding, tokens
from postledger.llm.queries import _model_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if often[g] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, edge):
    rows = edge_rows() + [(100, "a b c a b c\nx\n\nx\n#*<\n", "en", "a", 0), (101, "w w w w", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, quality.measures(docs).drop("host").collect()), key=repr)
    assert got == sorted(((r[0], *counts(r[1])) for r in rows), key=repr)


def test_quality_verdicts(spark, edge, empty):
    good, bad = " ".join(f"word{i}" for i in range(80)), "spam " * 80
    rows = [(i, good + f" {i}", "en", f"h{i % 5}", 0) for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "en", "spammy", 0) for i in range(100)]
    rows += [(2000, bad, "en", "tiny", 0), (2001, good, "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(got[i]["kept"] for i in range(200))
    # the clean tenth of a host of failures goes with it, one failure of a small host condemns nobody
    assert not any(got[1000 + i]["kept"] for i in range(100)) and got[1000]["host_rejected"] and not got[1000]["base_failed"]
    assert got[2001]["kept"] and not got[2000]["kept"]
    assert quality.judge(edge).count() == len(edge_rows())
    assert quality.judge(empty).count() == 0


def test_prior_of_hosts_that_differ_by_chance_only(spark):
    """Hosts of one true rate are drawn to the mean; hosts that do differ keep most of their own rate."""
    import random

    rng = random.Random(2)
    names = [f"fails_{r}" for r in quality.RULES]
    chance = [(f"h{h}", *[rng.random() < 0.1 for _ in names]) for h in range(20) for _ in range(50)]
    apart = [(f"h{h}", *[rng.random() < (0.9 if h % 2 else 0.05) for _ in names]) for h in range(20) for _ in range(50)]
    schema = "host string, " + ", ".join(f"{n} boolean" for n in names)
    for rows, least, most in ((chance, 0.0, 0.02), (apart, 0.3, 1.0)):
        hosts = quality.host_verdicts(spark.createDataFrame(rows, schema)).collect()
        mean = sum(r[1] for r in rows) / len(rows)
        rule = f"rate_{quality.RULES[0]}"
        off = max(abs(r[rule] - mean) for r in hosts)
        assert least <= off <= most, (off, mean)


@pytest.fixture(scope="module")
def proto():
    return _model_file("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (2000, 64), (300, 8)])
def test_token_counts_equal_the_library(edge, proto, chunk, overlap):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    got = tokens.count_tokens(edge, proto, chunk_bytes=chunk, overlap_bytes=overlap).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in edge_rows()]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_token_counts_of_awkward_texts(spark, empty, proto):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = [" " * 3000, "a" * 3000, "ab  cd\n" * 500, "漢字かな交じり文" * 200, "▁x ▁" * 300, "<s> </s> <unk>" * 100, "é" * 999, "😀 " * 500, "=" * 2500 + " tail",
             " lead", "trail ", "\n\n\n" * 400, "aaaa bbbb" * 300 + "x" * 1000 + " c" * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, proto, chunk_bytes=256, overlap_bytes=16).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}
    assert tokens.count_tokens(empty, proto).count() == 0


def test_mixing_rates_and_stability(spark, edge, empty):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 4 > 0, "big").when(F.col("id") % 8 == 0, "small").alias("source"))
    targets = spark.createDataFrame([("big", 1.0), ("small", 2.0), (None, 1.0)], "source string, weight double")
    got = {r["source"]: r["n"] for r in mixing.mix(docs, targets).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 10_000) < 400 and abs(got["small"] - 20_000) < 600 and abs(got[None] - 10_000) < 400
    a = sorted(map(tuple, mixing.mix(edge).collect()), key=repr)
    assert a == sorted(map(tuple, mixing.mix(edge.repartition(7)).collect()), key=repr)
    assert mixing.mix(edge).columns == [c for c in edge.columns if c != "copy_no"] + ["copy_no", "shuffle_key"]
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 90.0, 5000.0])
def test_poisson_mean_and_variance(spark, rate):
    u = (F.col("id") + 0.5) / 4000
    k = mixing.poisson(F.lit(float(min(rate, mixing.LARGEST_PART))), u)
    r = spark.range(4000).select(k.alias("k")).agg(F.avg("k"), F.variance("k")).first()
    want = min(rate, mixing.LARGEST_PART)
    assert abs(r[0] - want) < 0.01 * want + 0.01 and abs(r[1] - want) < 0.05 * want + 0.01


def test_large_rates_are_sums_of_parts(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "one") for i in range(3)], "doc_id long, text string, source string")
    n = mixing.mix(docs, total=6000).count()
    assert abs(n - 6000) < 500


def test_differencing_beats_greedy_bins():
    assert sorted(sharding.differencing([8, 7, 6, 5, 4], 2).tolist()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])
    sizes = [(i * 7919) % 1000 + 1 for i in range(2000)]
    shard = sharding.differencing(sizes, 7)
    sums = [sum(s for s, k in zip(sizes, shard) if k == j) for j in range(7)]
    assert max(sums) - min(sums) <= 2
    assert sharding.differencing([], 3).tolist() == [] and set(sharding.differencing([5, 5], 1)) == {0}


def test_sharding(spark, edge, empty):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 50), "en", "a", 0) for i in range(3000)] + edge_rows()
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    assert len(got) == len(rows)
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((None if d != d else int(d), s, c) for d, s, c in zip(got["doc_id"], got["size"], got["text_crc32"])), key=repr) == want
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(got["shard"]) <= set(range(40)) and got["grown_shard"].isna().all()
    sums = got.groupby("shard")["size"].sum()
    heavy = got.groupby("text_crc32")["size"].sum().max()
    assert sums.max() <= max(heavy, sums.sum() / 40 * 1.05)
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(edge).count() == len(edge_rows())


def test_sharding_with_few_grains(spark):
    docs = spark.createDataFrame([(i, "y" * (i % 97)) for i in range(5000)], "doc_id long, text string")
    sums = sharding.shard_documents(docs, n_shards=4, grains=16).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert sums.max() - sums.min() < 0.1 * sums.mean()
