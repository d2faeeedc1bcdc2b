import hashlib
import random

import pytest
import xxhash
from postledger.llm import ctph


def plain_fingerprint(text):
    """Boundaries found byte by byte, the block size doubled until they are few enough."""
    data = text.encode()
    mask = 0xFFFFFFFF
    zeros = []
    for i in range(len(data)):
        h = 0
        for k in range(i - 6, i + 1):
            h = (h * 0x01000193 + (data[k] if k >= 0 else 0) + 1) & mask
        h ^= h >> 16
        h = h * 0x7FEB352D & mask
        h ^= h >> 15
        h = h * 0x846CA68B & mask
        h ^= h >> 16
        zeros.append(next((b for b in range(32) if h >> b & 1), 32))
    size = 4
    while sum(z >= size.bit_length() - 1 for z in zeros) >= 64:
        size *= 2
    parts = []
    for level in (size.bit_length() - 1, size.bit_length()):
        pieces, start = [], 0
        for i, z in enumerate(zeros):
            if z >= level:
                pieces.append(data[start:i + 1])
                start = i + 1
        pieces += [data[start:]] if data[start:] else []
        hashes = [xxhash.xxh32_intdigest(p) for p in pieces]
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        parts.append("".join(letters[h % 64] + letters[h // 64 % 64] for h in hashes))
    return f"{size}:{parts[0]}:{parts[1]}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    (s, *x), (t, *y) = a.split(":"), b.split(":")
    for i in (0, 1):
        for j in (0, 1):
            u, v = ([z[k:k + 2] for k in range(0, len(z), 2)] for z in (x[i], y[j]))
            if int(s) << i == int(t) << j and u and v:
                row = list(range(len(v) + 1))  # edit distance without replacement
                for m, p in enumerate(u, 1):
                    new = [m]
                    for n, q in enumerate(v, 1):
                        new.append(row[n - 1] if p == q else min(row[n], new[-1]) + 1)
                    row = new
                best = max(best, 1 - row[-1] / (len(u) + len(v)))
    return best


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé漢😀", k=rng.randint(1, 8))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 500))) for _ in range(n)]


def test_fingerprints_and_likeness_against_plain():
    texts = [*random_texts(40), "", "a", "abc" * 4000, "\x00" * 500]
    prints = [ctph.fingerprint(t) for t in texts]
    assert prints == [plain_fingerprint(t) for t in texts]
    for a in prints[:12] + prints[-4:]:
        for b in prints[:12] + prints[-4:]:
            assert ctph.likeness(a, b) == pytest.approx(plain_likeness(a, b), abs=1e-12)


def test_blocks_of_long_texts_leave_no_trace(monkeypatch):
    text = " ".join(random_texts(20))
    want = ctph.fingerprint(text)
    for block in (7, 100, 4096):
        monkeypatch.setattr(ctph, "_BLOCK", block)
        assert ctph.fingerprint(text) == want


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (d, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        a, b, c = map(plain_fingerprint, (text, new, following))
        out.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 12), round(plain_likeness(a, c), 12)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((*r[:5], round(r[5], 12), round(r[6], 12)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_neighbours_across_partitions(spark, partitions):
    texts = random_texts(30, 8)
    rows = list(zip([7 * i % 31 for i in range(30)], texts))
    rows[4], rows[9] = (rows[4][0], None), (rows[9][0], rows[8][1])
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert rows_of(ctph.compare_neighbours(df)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_edges(spark, edge, empty):
    assert ctph.compare_neighbours(empty).collect() == []
    got = ctph.compare_neighbours(edge).collect()
    assert len(got) == edge.count()
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None}
    assert prints[5] == prints[6] and prints[1] == prints[2] == "4::"
    assert {r["near_next"] for r in got if r["doc_id"] == 1} == {1.0}
    lone = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    assert ctph.compare_neighbours(lone).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_half_of_a_text_is_recognised():
    texts = [t for t in random_texts(60, 11) if len(t) > 400]
    scores = []
    for a, b in zip(texts, texts[1:]):
        own = ctph.fingerprint(a)
        scores.append((ctph.likeness(own, ctph.fingerprint(ctph.edited(a, b))), ctph.likeness(own, ctph.fingerprint(b))))
    assert sum(x > 0.25 for x, _ in scores) >= 0.95 * len(scores) and max(y for _, y in scores) < 0.2
