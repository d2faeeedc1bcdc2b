"""Context-triggered piecewise hashing of whole texts and its likeness."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_rows, type_of

WINDOW = 7
#: A signature has at most so many pieces; the block size doubles until that holds.
PIECES = 64
LEAST_LEVEL = 2
_BLOCK = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _levels(data: np.ndarray, lead: int) -> np.ndarray:
    """Trailing zero bits of the rolling hash at every byte from ``lead`` on; it sees WINDOW bytes."""
    wide = np.concatenate([np.zeros(WINDOW - 1 - lead, np.uint32), data.astype(np.uint32)])
    n = len(wide) - WINDOW + 1
    h = np.zeros(n, dtype=np.uint32)
    for k in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += wide[k:k + n] + np.uint32(1)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return np.bitwise_count((h & (~h + np.uint32(1))) - np.uint32(1))


def boundaries(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The level, and the ends of all pieces at that level and at the next one.

    A piece ends where the rolling hash has at least ``level`` trailing zeros,
    so the ends at one level are among those of the level below. The level is the
    smallest with fewer than PIECES ends in the whole text. Long texts are
    hashed in blocks; what is kept between blocks is below PIECES ends.
    """
    level, at, height = LEAST_LEVEL, np.zeros(0, np.int64), np.zeros(0, np.uint8)
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), _BLOCK):
        lead = min(start, WINDOW - 1)
        found = _levels(whole[start - lead:start + _BLOCK], lead)
        new = np.flatnonzero(found >= level)
        at, height = np.concatenate([at, new + start]), np.concatenate([height, found[new]])
        while len(at) >= PIECES:
            level += 1
            kept = height >= level
            at, height = at[kept], height[kept]
    return level, at + 1, at[height > level] + 1


def _signature(data: bytes, ends: np.ndarray) -> str:
    import xxhash

    out, start = [], 0
    for end in [*ends.tolist(), len(data)]:
        if end > start:
            h = xxhash.xxh32_intdigest(data[start:end])
            out.append(_LETTERS[h & 63] + _LETTERS[h >> 6 & 63])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice that size``; two letters stand for one piece."""
    data = text.encode("utf-8")
    level, fine, coarse = boundaries(data)
    return f"{1 << level}:{_signature(data, fine)}:{_signature(data, coarse)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as one integer."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else 1 - edit distance / pieces of both, at the best block size that both have.

    The distance counts inserted and deleted pieces. Fingerprints without a common block size have likeness 0.
    """
    if a == b:
        return 1.0
    best = 0.0
    sides = []
    for f in (a, b):
        size, fine, coarse = f.split(":")
        sides.append({int(size): fine, 2 * int(size): coarse})
    for size in sides[0].keys() & sides[1].keys():
        x, y = ([s[size][k:k + 2] for k in range(0, len(s[size]), 2)] for s in sides)
        if x and y:
            best = max(best, 2 * _common(x, y) / (len(x) + len(y)))
    return best


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs`` (doc_id, text), of its edited text, and likenesses.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The next document is the one that follows in
    ascending order of doc_id, after the last one the first. Null ids come
    first; rows of one id are ordered by a hash of their text, then by the text,
    so equal rows are interchangeable. Null texts are empty; an empty text has
    an empty signature and is like empty texts only. A single row follows
    itself. Other columns are ignored; an empty table gives no rows.

    Rows are range-partitioned once and walked in order. What lies across the
    end of a partition is settled afterwards, from one first and one last row
    of each partition.
    """
    kind = type_of(docs, "doc_id")
    result = [("doc_id", kind), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
              ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    names = [n for n, _ in result]

    def finish(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
        new = edited(text, following)
        new_own = fingerprint(new)
        return (doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), own, new_own,
                likeness(own, new_own), likeness(own, next_own))

    def walk(batches) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        empty = (None,) * len(names)
        columns = [*names, "part", "edge", "id", "text"]
        for ids, texts in batches:
            out = []
            for doc_id, text in zip(ids, texts):
                own = fingerprint(text)
                if last is None:
                    out.append((*empty, part, "first", doc_id, text))
                else:
                    out.append((*finish(*last, text, own), None, None, None, None))
                last = doc_id, text, own
            yield dict(zip(columns, map(list, zip(*out)))) if out else {c: [] for c in columns}
        if last is not None:
            yield dict(zip(columns, map(list, zip((*empty, part, "last", last[0], last[1])))))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    done = cut_lineage(map_rows(rows, [*result, ("part", "int"), ("edge", "string"), ("id", kind), ("text", "string")], walk))

    firsts = done.filter("edge = 'first'").select("part", "text")
    # one narrow row for each partition that has rows
    parts = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    pairs = (done.filter("edge = 'last'").select("part", F.col("id").alias("doc_id"), "text").join(parts, "part")
             .join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next"))

    def close(batches) -> Iterator[dict[str, list]]:
        for ids, texts, following in batches:
            out = [finish(d, t, fingerprint(t), f, fingerprint(f)) for d, t, f in zip(ids, texts, following)]
            yield dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

    return done.filter("edge is null").select(*names).unionByName(map_rows(pairs.select("doc_id", "text", "following"), result, close))
