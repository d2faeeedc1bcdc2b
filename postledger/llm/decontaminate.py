"""Benchmark decontamination by spaced seeds over words."""
from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_BATCH, cut_lineage, group_key, type_of, utf8

#: Spaced seeds: 1 compares a word, 0 ignores it. Every stretch of 12 to 23 words with at most a
#: fifth of them substituted agrees with some item on some seed at some place (tested for all choices
#: of places); longer stretches hold such a one. Shorter items have seeds of their own length
#: (``short_seeds``), so no leak as defined here is missed.
SEEDS = ("111011", "11010011", "110100101")
#: A leak is an aligned stretch of at least so many words, or the whole of a shorter item,
MIN_WORDS = 12
#: of which this share agree.
SIMILARITY = 0.8
#: Bits of the filter over the benchmark's hashes; its size does not depend on the benchmark.
FILTER_BITS = 1 << 24
_WORD = re.compile(r"\w+")


def word_hashes(text: str, memo: dict[str, int]) -> np.ndarray:
    """Hash of each word of the lower-cased text (runs of letters, digits and _)."""
    import xxhash

    words = _WORD.findall(text.lower())
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > 300_000:
                memo.clear()
            h = memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        out.append(h)
    return np.array(out, dtype=np.uint64)


def seed_hashes(words: np.ndarray, seeds: tuple[str, ...] = SEEDS):
    """For each seed, the hashes of the compared words at every place where the seed fits."""
    for number, seed in enumerate(seeds):
        n = len(words) - len(seed) + 1
        if n <= 0:
            yield number, np.zeros(0, dtype=np.uint64)
            continue
        h = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
        for k, c in enumerate(seed):
            if c == "1":
                h ^= words[k:k + n]
                h *= np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(29)
        yield number, h


def short_seeds(length: int, similarity: float = SIMILARITY) -> list[str]:
    """Seeds as long as a whole item of ``length`` words, of which one compares none of any tolerated choice of places."""
    free = length - int(np.ceil(similarity * length - 1e-9))
    parts = min(free + 2, length) if free else 1
    block = [k * parts // length for k in range(length)]
    return ["".join("0" if b in gone else "1" for b in block) for gone in itertools.combinations(range(parts), free)]


def short_hashes(words: np.ndarray, lengths: list[int], similarity: float):
    """The same as ``seed_hashes`` for the seeds of whole items of the given lengths."""
    for length in lengths:
        for number, h in seed_hashes(words, tuple(short_seeds(length, similarity))):
            yield number, h * np.uint64(2 * length + 1) ^ np.uint64(length)


def _items(benchmark: DataFrame, seeds: tuple[str, ...], min_words: int, similarity: float) -> DataFrame:
    """item_id, its word hashes, and seed hashes with their places."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = type_of(benchmark, "item_id")
    schema = pa.schema([("item_id", to_arrow_type(kind)), ("words", pa.binary()), ("places", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])

    def apply(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text.decode("utf-8"), memo)
                places, hashes = [], []
                own = short_hashes(words, [len(words)], similarity) if 0 < len(words) < min_words else seed_hashes(words, seeds)
                for _, h in own:
                    places.append(np.arange(len(h), dtype=np.int32))
                    hashes.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array([item], schema.field(0).type), pa.array([words.tobytes()], pa.binary()),
                    pa.array([np.concatenate(places)], schema.field(2).type), pa.array([np.concatenate(hashes)], schema.field(3).type)], schema=schema)

    return benchmark.filter("item_id is not null").select("item_id", utf8().alias("text")).dropDuplicates().mapInArrow(
        apply, f"item_id {kind.simpleString()}, words binary, places array<int>, hashes array<long>")


def _filter(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for two places per hash; gathered as at most ``bits / 64`` numbers."""
    both = items.select(F.explode("hashes").alias("h")).select(F.explode(F.array(
        F.pmod(F.col("h"), F.lit(bits)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(bits)))).alias("b"))
    rows = both.groupBy(F.shiftright("b", 6).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("set")).toArrow()
    out = np.zeros(max(bits // 64, 1), dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint64)


def _candidates(docs: DataFrame, table, seeds: tuple[str, ...], bits: int, lengths: list[int], similarity: float) -> DataFrame:
    """Rows of ``docs`` of which some seed hash passes the filter, with their words and these hashes."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = type_of(docs, "doc_id")
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("row", pa.int64()), ("doc_words", pa.binary()), ("doc_places", pa.list_(pa.int32())), ("doc_hashes", pa.list_(pa.int64()))])

    def present(h: np.ndarray) -> np.ndarray:
        set_bits = table.value
        ok = np.ones(len(h), dtype=bool)
        # pmod of the signed hash by a power of two equals the low bits
        for b in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
            ok &= (set_bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok

    def apply(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                out = [[] for _ in schema]
                for doc, row, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = word_hashes(text.decode("utf-8"), memo)
                    places, hashes = [], []
                    for _, h in itertools.chain(seed_hashes(words, seeds), short_hashes(words, lengths, similarity)):
                        hit = np.flatnonzero(present(h))
                        if len(hit):
                            places.append(hit.astype(np.int32))
                            hashes.append(h[hit].view(np.int64))
                    if places:
                        for col, v in zip(out, (doc, row, words.tobytes(), np.concatenate(places), np.concatenate(hashes))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), utf8().alias("text")).mapInArrow(
        apply, f"doc_id {kind.simpleString()}, row long, doc_words binary, doc_places array<int>, doc_hashes array<long>")


def best_stretch(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch that starts and ends with agreement and agrees in at least ``similarity`` of its places."""
    # a stretch [i, j) will do where the prefix sums of (same - similarity) do not fall between i and j
    sums = np.concatenate([[0.0], np.cumsum(same - similarity)])
    least = np.minimum.accumulate(sums)
    best = (0, 0)
    for j in range(len(same), 0, -1):
        if j <= best[1] - best[0]:
            break
        if same[j - 1]:
            # earliest start whose sum is not above that at j: running minima fall, so bisect
            i = int(np.searchsorted(-least, -(sums[j] + 1e-9)))
            while i < j and not same[i]:  # dropping a difference only helps
                i += 1
            if j - i > best[1] - best[0]:
                best = (i, j)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, seeds: tuple[str, ...] = SEEDS, min_words: int = MIN_WORDS,
          similarity: float = SIMILARITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Passages of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): one row per document, item and place.

    Columns: doc_id, row, item_id, doc_start, item_start (words, from 0),
    n_words, n_equal. Test hashes and training hashes are joined by shuffle; a
    bit filter of fixed size, broadcast, drops the training hashes that no
    item has before that join. Hits of an item on one diagonal (difference of places)
    are one candidate, for which the words around the hits are compared. A leak
    is the longest aligned stretch of at least ``min_words`` words, or of all
    words of a shorter item, with at least ``similarity`` equal words. Shorter
    items are joined on hashes of their own length that leave out the words
    that may differ; there are fewer than ``min_words`` such lengths.
    Substituted words are tolerated, inserted or deleted ones end a stretch.

    Null texts are empty, items without words leak nothing, a null item_id is not searched, a null doc_id
    is reported as such, repeated rows are reported each (``row`` tells them
    apart), repeated items once, other columns are ignored, empty tables give
    no rows.
    """
    if filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two")
    items = cut_lineage(_items(benchmark, seeds, min_words, similarity))
    size = F.expr("octet_length(words) div 8")
    lengths = sorted(r["n"] for r in items.select(size.cast("int").alias("n")).filter((F.col("n") > 0) & (F.col("n") < min_words)).distinct().collect())
    table = docs.sparkSession.sparkContext.broadcast(_filter(items, filter_bits))  # filter_bits / 8 bytes
    found = cut_lineage(_candidates(docs, table, seeds, filter_bits, lengths, similarity))
    test = items.select("item_id", F.explode(F.arrays_zip("places", "hashes")).alias("t")).select(
        "item_id", F.col("t.hashes").alias("h"), F.col("t.places").alias("item_place"))
    train = found.select("row", F.explode(F.arrays_zip("doc_places", "doc_hashes")).alias("t")).select(
        "row", F.col("t.doc_hashes").alias("h"), F.col("t.doc_places").alias("doc_place"))
    diagonals = train.join(test, "h").select(
        "row", "item_id", (F.col("doc_place") - F.col("item_place")).alias("diagonal")).distinct()
    # each candidate takes only the words that its item can cover
    first = F.greatest("diagonal", F.lit(0))
    last = F.least(F.col("diagonal") + size, F.expr("octet_length(doc_words) div 8"))
    kind = type_of(benchmark, "item_id")
    pairs = (
        diagonals.join(found.select("doc_id", "row", "doc_words"), "row").join(items.select("item_id", "words"), "item_id")
        .select("doc_id", "row", "item_id", first.cast("long").alias("first"), (first - F.col("diagonal")).cast("long").alias("skipped"), "words",
                F.substring("doc_words", (first * 8 + 1).cast("int"), ((last - first) * 8).cast("int")).alias("part"))
    )
    from pyspark.sql.pandas.types import to_arrow_type

    doc_kind = type_of(docs, "doc_id")
    schema = pa.schema([("doc_id", to_arrow_type(doc_kind)), ("row", pa.int64()), ("item_id", to_arrow_type(kind)), ("doc_start", pa.int64()),
                        ("item_start", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])

    def verify(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for doc, row, item, at, skipped, words, part in zip(*(c.to_pylist() for c in batch.columns)):
                theirs = np.frombuffer(words, dtype=np.uint64)
                ours = np.frombuffer(part, dtype=np.uint64)
                same = theirs[skipped:skipped + len(ours)] == ours
                if len(theirs) < min_words:  # the whole item or nothing, whichever words differ
                    whole = len(same) == len(theirs) and same.sum() >= similarity * len(same) - 1e-9
                    i, j = 0, len(same) if whole else 0
                else:
                    i, j = best_stretch(same, similarity)
                if j > i and j - i >= min(min_words, len(theirs)):
                    for col, v in zip(out, (doc, row, item, at + i, skipped + i, j - i, int(same[i:j].sum()))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return pairs.mapInArrow(verify, f"doc_id {doc_kind.simpleString()}, row long, item_id {kind.simpleString()}, doc_start long, item_start long, n_words long, n_equal long")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no leak; leaks without a doc_id remove rows without one.

    The list of leaking documents is written, so that Spark broadcasts it only
    where its real size allows.
    """
    bad = cut_lineage(leaks(docs, benchmark, **how).select(group_key("doc_id").alias("_doc")).distinct())
    return docs.withColumn("_doc", group_key("doc_id")).join(bad, "_doc", "left_anti").select(*docs.columns)
