"""Sharding and the quality classifier against plain versions of the same methods."""
import math
import random
import zlib

import numpy as np
import xxhash
from postledger.llm import nbsvm, sharding


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_differencing(sizes, n):
    """Lists of (sum, members), the two of largest spread combined by a scan over all."""
    parts = [([size] + [0] * (n - 1), [[i]] + [[] for _ in range(n - 1)], k) for k, (i, size) in enumerate(enumerate(sizes))]
    born = len(parts)
    while len(parts) > 1:
        spread = lambda p: (-(p[0][0] - p[0][-1]), p[2])
        parts.sort(key=spread)
        (sa, ma, _), (sb, mb, _) = parts[:2]
        joined = [(x + y, a + b) for x, y, a, b in zip(sa, reversed(sb), ma, reversed(mb))]
        joined.sort(key=lambda t: -t[0])
        parts = parts[2:] + [([s for s, _ in joined], [m for _, m in joined], born)]
        born += 1
    return {i: k for _, members, _ in parts for k, own in enumerate(members) for i in own}


def test_shards_of_every_row(spark):
    rng = random.Random(9)
    texts = ["same group of rows"] * 30 + ["".join(rng.choices("abc é", k=rng.randint(0, 90))) for _ in range(150)] + [None, "", "x" * 3000]
    rng.shuffle(texts)
    grains, shards = 32, 7
    key = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    size = lambda t: len((t or "").encode()) + 16
    total = sum(map(size, texts))
    groups = {}
    for t in texts:
        groups[key(t)] = groups.get(key(t), 0) + size(t)
    units, unit_of = {}, {}
    for k, n in groups.items():
        # a group above 1 / grains of all bytes is a unit, the others share one by a hash of their key
        grain = signed(xxhash.xxh64_intdigest(int(1).to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42))) % grains
        unit = (True, signed(k)) if n * grains > total else (False, grain)
        unit_of[k] = unit
        units[unit] = units.get(unit, 0) + n
    order = sorted(units, key=lambda u: (-units[u], not u[0], u[1]))
    shard = plain_differencing([units[u] for u in order], shards)
    placed = {u: shard[i] for i, u in enumerate(order)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, shards, grains).collect()}
    assert got == {i: placed[unit_of[key(t)]] for i, t in enumerate(texts)}
    assert any(u[0] for u in units) and any(not u[0] for u in units)


def plain_scores(rows, labels):
    """Naive Bayes support vectors with dictionaries and loops."""
    own = nbsvm.Grams()
    grams = {i: own.of((t or "").encode()) for i, t in rows}
    h = {i: signed(xxhash.xxh64_intdigest(str(i).encode(), 42)) for i in grams}
    known = sorted((i for i in grams if i in labels and zlib.crc32(str(i).encode()) % 5), key=lambda i: h[i])
    n = {y: sum(labels[i] == y for i in known) for y in (0, 1)}
    count = [{}, {}]
    for i in known:
        for g in grams[i]:
            count[labels[i]][g] = count[labels[i]].get(g, 0) + 1
    # the counted classes share the smoothing of one for each
    ratio = lambda g: math.log((1 + count[1].get(g, 0)) / (n[1] + 2)) - math.log((1 + count[0].get(g, 0)) / (n[0] + 2))
    last = len(known) - len(known) // 5 if len(known) >= 50 else len(known)
    fitted = known[:last]
    share = sum(labels[i] for i in fitted) / len(fitted)
    weights, bias = {}, 0.0
    alpha = dict.fromkeys(fitted, 0.0)
    value = {i: {g: ratio(g) / math.sqrt(max(len(grams[i]), 1)) for g in grams[i]} for i in known}
    rng = np.random.default_rng(0)
    for _ in range(nbsvm.EPOCHS):
        for at in rng.permutation(len(fitted)):
            i = fitted[at]
            sign = 1 if labels[i] else -1
            norm = sum(v * v for v in value[i].values()) + 1
            margin = sum(weights.get(g, 0.0) * v for g, v in value[i].items()) + bias
            cost = nbsvm.COST * 0.5 / (share if labels[i] else 1 - share)
            new = min(max(alpha[i] - (sign * margin - 1) / norm, 0.0), cost)
            for g, v in value[i].items():
                weights[g] = weights.get(g, 0.0) + (new - alpha[i]) * sign * v
            bias += (new - alpha[i]) * sign
            alpha[i] = new
    used = [abs(w) for w in weights.values() if abs(w) > 1e-9]
    mean = sum(used) / len(used)
    blended = lambda g: ((1 - nbsvm.BLEND) * mean + nbsvm.BLEND * weights.get(g, 0.0)) * ratio(g)
    margin = {i: sum(map(blended, gs)) / math.sqrt(max(len(gs), 1)) + bias for i, gs in grams.items()}
    held = known[last:]
    if not held or len({labels[i] for i in held}) < 2:
        held = known
    slope, shift = nbsvm._sigmoid(np.array([margin[i] for i in held]), np.array([labels[i] == 1 for i in held]))
    return {i: 1 / (1 + math.exp(-(slope * m + shift))) for i, m in margin.items()}


def test_scores_of_every_row(spark):
    rng = random.Random(4)
    good, bad = [f"word{i}" for i in range(60)], [f"JUNK{i}" for i in range(20)] + ["buy", "now", "!!!"]
    rows, labels = [], {}
    for i in range(160):
        kind = rng.random() < 0.6
        mixed = [rng.choice(good if rng.random() < (0.8 if kind else 0.3) else bad) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(mixed)))
        if i % 8:
            labels[i] = int(kind)
    rows += [(500, None), (501, ""), (502, "neverseen " + "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in nbsvm.score(docs, marked).collect()}
    want = plain_scores(rows, labels)
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_outlines_are_of_whole_words():
    long = "ab1-" * 400
    assert nbsvm.form(long + "Z") != nbsvm.form(long + "9") and nbsvm.form("aaaa11") == "aa99"
