"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import among, cut_lineage, map_rows, type_of, utf8, without
from .components import components as graph_components

WORDS = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Buckets of at most so many fingerprints are compared directly, larger ones are split by more masks.
DIRECT = 1024
#: Up to so many free bits a bucket is compared directly: it has at most 2 ** FREE fingerprints.
FREE = 12
_PART = 1 << 15


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles; zero for a text without words."""
    import xxhash

    tokens = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return int(np.uint64(digest(joined, seed)).view(np.int64))
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _PART):
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at:at + _PART], ends[at:at + _PART])), dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp of every row of ``docs`` (doc_id, text)."""
    def rows_of(batches):
        for ids, texts in batches:
            yield {"doc_id": ids, "fp": [fingerprint(t, words, seed) for t in texts]}

    return map_rows(docs.select("doc_id", utf8().alias("text")), [("doc_id", type_of(docs, "doc_id")), ("fp", "long")], rows_of)


def covering_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that each extend ``mask``; two values that agree on ``mask`` and differ in at most
    ``radius`` bits agree on at least one of them.

    With enough free bits: bit i gets the nonzero vector m(i) of radius + 1
    bits, and the mask of a nonzero vector v has the bits with odd <m(i), v>.
    The vectors of ``radius`` differing bits span less than the whole space, so
    some v is orthogonal to all of them. With few free bits: these are cut into
    radius + 1 blocks, of which one has no differing bit.
    """
    free = [i for i in range(BITS) if not mask >> i & 1]
    vectors = (1 << (radius + 1)) - 1
    if len(free) >= vectors:
        chosen = [[b for j, b in enumerate(free) if (1 + j % vectors & v).bit_count() % 2] for v in range(1, vectors + 1)]
    else:
        chosen = [free[k::radius + 1] for k in range(radius + 1)]
    return [mask | sum(1 << b for b in bits) for bits in chosen]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _linked(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the values within ``radius`` of each other, as (smallest, member)."""
    left, out = np.sort(values).view(np.uint64), []  # signed numbers would be counted by their absolute value
    while len(left) > 1:
        group, left = left[:1], left[1:]
        front = group
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 128):
                near |= (np.bitwise_count(front[at:at + 128, None] ^ left[None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            out.extend((int(group.view(np.int64)[0]), int(x)) for x in front.view(np.int64))
    return out


def _expand(rows: DataFrame, radius: int) -> DataFrame:
    """``(mask, fp)`` to ``(mask, bucket, fp)`` for every covering mask of the row's mask."""
    schema = pa.schema([("mask", pa.int64()), ("bucket", pa.int64()), ("fp", pa.int64())])

    def apply(batches):
        for batch in batches:
            masks, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for mask in np.unique(masks):
                own = fps[masks == mask]
                for m in covering_masks(int(mask) % (1 << BITS), radius):
                    m = _signed(m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m)), pa.array(own & m), pa.array(own)], schema=schema)

    return rows.select("mask", "fp").mapInArrow(apply, "mask long, bucket long, fp long")


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets (mask null), and the rows of buckets that must be split (u, v null).

    Rows come sorted by bucket, so a task holds one bucket of at most DIRECT
    rows at a time, or one whose free bits bound its size.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("mask", pa.int64()), ("fp", pa.int64())])

    def block(u=(), v=(), mask=(), fp=()):
        n = max(len(u), len(fp))
        cols = [c if len(c) else [None] * n for c in (u, v, mask, fp)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    def small(mask: int) -> bool:
        return BITS - (int(mask) % (1 << BITS)).bit_count() <= FREE

    def apply(batches):
        held: list[np.ndarray] = []  # the open bucket so far
        name, size, hot = None, 0, False

        def close():
            if size > 1 and not hot:
                pairs = _linked(np.concatenate(held), radius)
                if pairs:
                    yield block(*zip(*pairs))

        for batch in batches:
            masks, buckets, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fps):
                continue
            new = np.flatnonzero((masks[1:] != masks[:-1]) | (buckets[1:] != buckets[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(fps)]])
            pair_u, pair_v = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if (masks[s], buckets[s]) != name:
                    yield from close()
                    held, size, hot = [], 0, False
                    name = (masks[s], buckets[s])
                    if e - s == 1 and e < len(fps):  # alone in its bucket
                        continue
                    if e - s == 2 and e < len(fps):
                        pair_u.append(s)
                        continue
                part, size = fps[s:e], size + e - s
                if hot:
                    yield block(mask=np.full(len(part), name[0]), fp=part)
                    continue
                held.append(part.copy())
                if size > DIRECT and not small(name[0]):
                    whole, held, hot = np.concatenate(held), [], True
                    yield block(mask=np.full(len(whole), name[0]), fp=whole)
            if pair_u:
                at = np.array(pair_u)
                a, b = fps[at], fps[at + 1]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
                if near.any():
                    yield block(a[near], b[near])
        yield from close()

    return rows.mapInArrow(apply, "u long, v long, mask long, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints that connect whatever lies within ``radius``.

    Every fingerprint is hashed into the buckets of all covering masks; inside
    a bucket fingerprints are compared and a spanning forest is kept, never all
    pairs. Buckets of more than DIRECT fingerprints are hashed again by masks
    over their free bits, at most three times, as free bits halve.
    """
    level = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    while level is not None:
        buckets = _expand(level, radius).repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
        done = cut_lineage(_compare(buckets, radius))
        pairs = done.filter("u is not null").select("u", "v")
        found = pairs if found is None else found.unionByName(pairs)
        rest = done.filter("mask is not null").select("mask", "fp").distinct()
        level = None if rest.isEmpty() else rest
    return found


def components(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text).

    Rows whose fingerprints differ in at most ``radius`` bits are linked; the
    component is the smallest doc_id reachable over links. Equal fingerprints
    are one node, so copies are never compared. Null and empty texts, and texts
    without words, have fingerprint zero, which links like any other. A null
    doc_id counts in no minimum (its component_id is null if all are null);
    repeated rows are kept; other columns are ignored; an empty table gives no
    rows.
    """
    rows = cut_lineage(fingerprints(docs, words, seed))
    return _named(rows, links(cut_lineage(rows.select("fp").distinct()), radius), "fp")


def _named(rows: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """``rows`` (doc_id and their node) with component_id, the smallest doc_id reachable over the links ``found``."""
    nodes = cut_lineage(rows.groupBy(node).agg(F.min("doc_id").alias("least")))
    graph = graph_components(found)
    linked = graph.select(F.col("node").alias(node), "component").join(nodes, node)
    least = linked.groupBy("component").agg(F.min("least").alias("group_least"))
    moved = linked.join(least, "component").select(node, "group_least")
    # written, so that both sides of the join are plain shuffles and Spark can split a node with very many rows
    named = cut_lineage(nodes.join(moved, node, "left").select(node, F.coalesce("group_least", "least").alias("component_id")))
    return rows.join(named, node).select("doc_id", node, "component_id")


def keep_one(docs: DataFrame, words: int = shingles.WORDS, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies, that of the smallest doc_id.

    Near copies are texts whose word shingles have at least this Jaccard
    similarity. Those with close fingerprints are found by covering masks, all other such pairs by exact
    filters; each is verified exactly, and groups are what they connect. Texts without words, null or empty ones included, are copies of each other. Rows that
    repeat a doc_id are one document, of which one row stays. Rows without a
    doc_id stay, as nothing names them. All columns are returned, whatever their
    names; an empty table gives no rows.
    """
    narrow = docs.select("doc_id", "text").filter("doc_id is not null")
    found = shingles.groups(narrow, words, similarity)
    least = found.groupBy("group").agg(F.min("doc_id").alias("least"))
    # a repeated doc_id may have several texts, so several groups: it stays if it is the least of each
    dropped = cut_lineage(found.join(least, "group").filter("doc_id > least").select("doc_id").distinct())
    repeated = cut_lineage(narrow.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    single = without(docs, dropped.unionByName(repeated), "doc_id")
    several = without(among(docs, repeated, "doc_id"), dropped, "doc_id").dropDuplicates(["doc_id"])
    return single.unionByName(several)
