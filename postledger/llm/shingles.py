"""Exact similarity links between texts: Jaccard of word shingles, by filters that lose no pair."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_BATCH, among, cut_lineage, type_of, utf8
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: Share of all shingles, by hash, that the first filter looks at. Beyond ``1 - SIMILARITY`` every share loses no pair.
SCREENED = 0.3
#: Screened shingles that a task sorts at once.
_AT_ONCE = 1 << 20
_MEMO = 100_000
#: Members of a hub that are verified in one task, with one copy of the hub.
_FAN = 256
#: Bits of fingerprints that differ at most in the first round.
RADIUS = 4
#: Sets of a shingle that are compared with all others of it in the second round, the most central ones; the last round compares the rest.
HUBS = (8,)


def shingle_set(text: bytes, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    import xxhash

    tokens = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(memo) > _MEMO:
        memo.clear()
    for t in set(tokens):
        if t not in memo:
            memo[t] = xxhash.xxh64_intdigest(t)
    w = np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h ^= w[k:k + n]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: the bits that over half of its hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _node(hashes: np.ndarray) -> bytes:
    """A name of the set; texts with equal sets are one node."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def least_shared(n: int, similarity: float) -> int:
    """How many of its ``n`` shingles a text shares at least with any similar one."""
    return int(np.ceil(similarity * n - 1e-9))


def _sets(batches, words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of (id, text) batches, some texts at a time."""
    memo: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_BATCH):
            part = batch.slice(at, ROWS_PER_BATCH)
            yield part.column(0), [shingle_set(t, words, memo) for t in part.column(1).to_pylist()]


def _screen(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(doc_id, node)`` of the rows that may be similar to another row or equal to one.

    A text may have at most ``n - least_shared(n)`` shingles that a similar text
    lacks. So of its shingles below a bound on the hash, the same bound for
    all texts, all but so many must occur in another text. Shingles that
    repeat among the texts of a task are settled there and sent once, so a
    shingle has as many rows as there are such tasks at most.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = type_of(docs, "doc_id")
    doc = pa.struct([("doc_id", to_arrow_type(kind)), ("node", pa.binary()), ("need", pa.int64())])
    schema = pa.schema([("h", pa.int64()), ("ref", pa.int64()), ("doc", doc)])
    bound = np.uint64(int(SCREENED * 2.0 ** 64))

    def apply(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        ids: list[pa.Array] = []
        nodes: list[bytes] = []
        allowed: list[int] = []
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, waiting
            sizes = np.array([len(x) for x in held])
            h, at = np.concatenate(held).view(np.int64), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            starts = np.ones(len(h), dtype=bool)
            starts[1:] = h[1:] != h[:-1]
            alone = starts.copy()
            alone[:-1] &= starts[1:]
            need = sizes - np.array(allowed) - np.bincount(at[~alone], minlength=len(held))
            refs = first + np.arange(len(held))
            rows = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(nodes, pa.binary()), pa.array(need, pa.int64())], fields=list(doc))
            # rows of documents travel under their own number, apart from shingles
            yield pa.RecordBatch.from_arrays([pa.array(refs), pa.array(refs), rows], schema=schema)
            h, ref = h[starts], np.where(alone[starts], refs[at[starts]] if len(at) else 0, -1)
            for k in range(0, len(h), 1 << 16):
                some = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(ref[some], mask=ref[some] < 0), pa.nulls(len(h[some]), doc)], schema=schema)
            first += len(held)
            for x in (ids, nodes, allowed, held):
                x.clear()
            waiting = 0

        for names, sets in _sets(batches, words):
            ids.append(names)
            for h in sets:
                nodes.append(_node(h))
                allowed.append(len(h) - least_shared(len(h), similarity))
                held.append(h[:np.searchsorted(h, bound)])
                waiting += len(held[-1])
            if waiting >= _AT_ONCE or len(held) >= _AT_ONCE >> 4:
                yield from flush()
        if held:
            yield from flush()

    name = f"struct<doc_id:{kind.simpleString()},node:binary,need:long>"
    rows = docs.select("doc_id", utf8().alias("text")).mapInArrow(apply, f"h long, ref long, doc {name}")
    is_doc = F.col("doc").isNotNull()
    same = Window.partitionBy("h", is_doc)
    shared = rows.withColumn("n", F.count("*").over(same)).filter(is_doc | ((F.col("n") > 1) & F.col("ref").isNotNull()))
    # the same node in two rows is a copy, found by its name alone
    judged = shared.groupBy("ref").agg(F.count_if(~is_doc).alias("found"), F.max("doc").alias("doc"))
    return cut_lineage(judged.filter(F.col("found") >= F.col("doc.need")).select("doc.doc_id", "doc.node"))


def _nodes(docs: DataFrame, screened: DataFrame, words: int) -> DataFrame:
    """``(id, node, n, fp, hashes)``: the sets of one row of each node, numbered, with their SimHash."""
    kind = type_of(docs, "doc_id")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    schema = to_arrow_schema(T.StructType([T.StructField("doc_id", kind), T.StructField("node", T.BinaryType()),
                                           T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("hashes", T.BinaryType())]))

    def apply(batches) -> Iterator[pa.RecordBatch]:
        for names, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([
                names, pa.array([_node(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()),
                pa.array([majority(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], schema=schema)

    first = screened.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = among(docs.select("doc_id", utf8().alias("text")), first, "doc_id")
    rows = texts.mapInArrow(apply, f"doc_id {kind.simpleString()}, node binary, n int, fp long, hashes binary")
    return cut_lineage(rows.filter("n > 0").select(F.monotonically_increasing_id().alias("id"), "node", "n", "fp", "hashes"))


def _prefixes(nodes: DataFrame, similarity: float) -> DataFrame:
    """``(h, id, n, m, at, score)``: of the ``m`` shingles that a set shares with others, the rarest.

    A set keeps so many that it has one in common with every similar set:
    ``m - least_shared(n) + 1``, rarest first by exact counts, then by hash.
    Sets that share too few have none. The ``score`` is the mean count of a
    set's shingles: highest for the text that a group of near copies stems from.
    """
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("least", pa.int32())])

    def spread(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(hashes, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h), pa.array(np.full(n, i)), pa.array(np.full(n, n, np.int32)),
                    pa.array(np.full(n, least_shared(n, similarity), np.int32))], schema=schema)

    rows = nodes.select("id", "n", "hashes").mapInArrow(spread, "h long, id long, n int, least int")
    counts = rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    rarest = Window.partitionBy("id").orderBy("c", "h")
    own = Window.partitionBy("id")
    placed = rows.join(counts, "h").withColumns({
        "at": F.row_number().over(rarest) - 1, "m": F.count("*").over(own), "score": F.sum("c").over(own) / F.col("n")})
    return cut_lineage(placed.filter(F.col("at") <= F.col("m") - F.col("least")).select("h", "id", "n", "m", "at", "score"))


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether the sizes, and the places of the first shared shingle, leave room for the similarity."""
    size = [F.col(f"{x}.n") for x in (a, b)]
    rest = F.least(*[F.col(f"{x}.m") - F.col(f"{x}.at") for x in (a, b)])
    return (F.least(*size) >= similarity * F.greatest(*size) - 1e-9) & (rest * (1 + similarity) >= similarity * (size[0] + size[1]) - 1e-9)


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sets are similar.

    Pairs with one ``u`` are dealt out by salts, a few hundred to each. The set
    of ``u`` travels once for each salt, ahead of the sets it is compared with.
    """
    sets = nodes.select("id", "hashes")
    fans = pairs.groupBy("u").agg(F.ceil(F.count("*") / _FAN).cast("int").alias("salts"))
    heads = fans.join(sets.withColumnRenamed("id", "u"), "u").select(
        "u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "hashes")
    members = pairs.join(fans, "u").join(sets.withColumnRenamed("id", "v"), "v").select(
        "u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), "v", "hashes")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def check(batches) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            good: list[tuple[int, int]] = []
            for u, v, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = np.frombuffer(hashes.as_py(), np.uint64)
                if v is None:
                    head = h
                    continue
                shared = len(np.intersect1d(head, h, assume_unique=True))
                if shared * (1 + similarity) >= similarity * (len(head) + len(h)) - 1e-9:
                    good.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], schema=schema)

    rows = heads.unionByName(members).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return cut_lineage(rows.select("u", "v", "hashes").mapInArrow(check, "u long, v long"))


def close(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v) of sets that connect all whose fingerprints differ in at most ``radius`` bits.

    Fingerprints meet in the buckets of covering masks, which give a spanning
    forest and never all pairs; sets of one fingerprint are tied to the first of them.
    """
    from .simhash import links  # that module builds on this one

    fps = nodes.select("id", "fp")
    first = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("first")))
    found = links(first.select("fp"), radius)
    ends = [first.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in ("u", "v")]
    across = found.join(ends[0], "u").join(ends[1], "v").select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    same = fps.join(first, "fp").filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    return cut_lineage(across.distinct().unionByName(same))


def candidates(prefixes: DataFrame, similarity: float, hubs: int | None, placed: DataFrame | None = None,
               compared: DataFrame | None = None) -> DataFrame:
    """Pairs (u, v) of sets with common shingles among their rarest ones that may be similar.

    For each shingle these are its ``hubs`` most central sets with all others,
    or all pairs without ``hubs``. Pairs within one component of ``placed`` (node,
    component), and pairs in ``compared``, are left out. Those stay whose
    common rarest shingles, with all that either set has beyond its rarest ones,
    could reach the similarity.
    """
    named = prefixes.withColumn("component", F.col("id"))
    if placed is not None:
        named = prefixes.join(placed.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("h")
    named = cut_lineage(named.join(mixed, "h", "left_semi"))
    centre = named
    if hubs is not None:
        # Spark trims each task's rows to the first ones before the shuffle
        rank = F.row_number().over(Window.partitionBy("h").orderBy(F.col("score").desc(), "id"))
        centre = named.withColumn("rank", rank).filter(F.col("rank") <= hubs)
    a, b = centre.alias("a"), named.alias("b")
    other = F.col("a.id") < F.col("b.id") if hubs is None else F.col("a.id") != F.col("b.id")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & other & (F.col("a.component") != F.col("b.component")) & _possible("a", "b", similarity))
    pairs = pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    if compared is not None:
        pairs = pairs.join(compared, ["u", "v"], "left_anti").join(compared.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_anti")
    rarest = prefixes.groupBy("id").agg(F.collect_list("h").alias("hs"), F.min("n").alias("n"), (F.min("m") - F.count("*")).alias("rest"))
    both = (pairs.join(rarest.select(F.col("id").alias("u"), F.struct("hs", "n", "rest").alias("a")), "u")
            .join(rarest.select(F.col("id").alias("v"), F.struct("hs", "n", "rest").alias("b")), "v"))
    # in the common order, what two sets share lies in both beginnings or behind the end of the shorter one
    most = F.size(F.array_intersect("a.hs", "b.hs")) + F.greatest("a.rest", "b.rest")
    return cut_lineage(both.filter(most * (1 + similarity) >= similarity * (F.col("a.n") + F.col("b.n")) - 1e-9).select("u", "v"))


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, group)`` of the rows of ``docs`` (doc_id, text) that are similar to another row, or may be.

    Rows with one group are connected by similar texts; a group is a name. Rows
    that are left out are similar to none. Texts without words are
    copies of each other. Nulls are empty texts, repeated rows have one group, other columns are
    ignored, an empty table gives no rows.

    Similarity is the Jaccard coefficient of the sets of word shingles. First
    texts that share too little with all others go (``_screen``). Sets whose SimHash
    fingerprints are close are found by covering masks (``close``). Similar
    sets may lie further apart, so the rest is joined on rarest shingles (``_prefixes``);
    that and the first step keep every similar pair. Of the sets with a common rare shingle each is
    compared with the most central ones, and only across
    components; those still in different components are then compared with
    each other. Every link is verified on whole sets.
    """
    screened = _screen(docs, words, similarity)
    nodes = _nodes(docs, screened, words)
    compared = close(nodes)
    links = _verified(compared, nodes, similarity)
    placed = components(links)
    prefixes = _prefixes(nodes, similarity)
    for hubs in (*HUBS, None):
        pairs = candidates(prefixes, similarity, hubs, placed, compared)
        if pairs.isEmpty():
            continue
        compared = compared.unionByName(pairs)
        found = _verified(pairs, nodes, similarity)
        if not found.isEmpty():
            links = links.unionByName(found)
            placed = components(links)
    # rows of one node are copies; a repeated node has several numbers, which are linked
    parts = nodes.select("id", "node").join(placed.withColumnRenamed("node", "id"), "id").groupBy("node").agg(F.min("component").alias("component"))
    return cut_lineage(screened.join(parts, "node", "left").select(
        "doc_id", F.coalesce(F.col("component").cast("string"), F.hex("node")).alias("group")).distinct())
