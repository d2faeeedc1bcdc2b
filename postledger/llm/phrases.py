"""Phrase collocations: FM-indexes over word ids, one for each shard of the text, whose counts are summed."""
from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import top_n_per_group
from .common import cut_lineage, map_rows

#: Words of a shard; a piece is never cut, so a shard may have one piece more.
SHARD_WORDS = 6 << 20
LEAST, TOP, SHARE = 10, 2000, 50
_LOCAL_BITS, _SHARD_BITS = 26, 16
#: Rows that a task hands over at once.
_AT_ONCE = 1 << 14
#: Lower-cases A-Z and turns the ends of pieces into a byte that no UTF-8 text has.
_END = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- the index of a shard -------------------------------------------------

def build(ids: np.ndarray) -> bytes:
    """The Burrows-Wheeler transform of ``ids`` (zero ends a piece), rotations sorted by three words, packed.

    It is the whole index: counts of words are those of its symbols, and the
    last-to-first mapping is its stable sort order.
    """
    import zstandard

    order = np.lexsort((np.roll(ids, -2), np.roll(ids, -1), ids))
    order -= 1
    bwt = ids[order].astype("<i4", copy=False)
    del order
    return zstandard.ZstdCompressor(level=1).compress(bwt.view(np.uint8).reshape(-1, 4).T.tobytes())


class Index:
    """Intervals of all patterns of one and two words of a shard, and their extensions.

    Row ``following[j]`` holds the suffix that begins one word after that of row
    ``j``. So a row of the interval of ``yz`` leads back to a row of ``xyz`` (extension
    to the left, the last-to-first step), and rows of the interval of ``xy``
    are sorted by what follows (extension to the right). Rows are exact to a
    depth of three words, as they were sorted.
    """

    def __init__(self, packed: bytes):
        import zstandard

        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        bwt = np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()
        self.following = np.argsort(bwt, kind="stable").astype(np.int32)
        self.first = bwt[self.following]
        self.second = self.first[self.following]
        changed = np.ones(len(bwt), dtype=bool)
        changed[1:] = (self.first[1:] != self.first[:-1]) | (self.second[1:] != self.second[:-1])
        self.starts = np.flatnonzero(changed)
        self.pair = np.cumsum(changed, dtype=np.int32) - 1

    def pairs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, first, second, count) of every pattern of two words that are ``known``."""
        counts = np.diff(self.starts, append=len(self.first))
        x, y = self.first[self.starts], self.second[self.starts]
        at = np.flatnonzero(known[x] & known[y])
        return at, x[at], y[at], counts[at]

    def triples(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval of the first two words, interval of the last two, count), where both intervals are ``live``."""
        rows = np.flatnonzero(live[self.pair])
        left, right = self.pair[rows], self.pair[self.following[rows]]
        both = live[right]
        left, right = left[both], right[both]
        if not len(left):
            return left, right, left
        # the last words of an interval ascend with the rows, so equal ones are side by side
        changed = np.ones(len(left), dtype=bool)
        changed[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        at = np.flatnonzero(changed)
        return left[at], right[at], np.diff(at, append=len(left))


def _shards(docs: DataFrame, shard_words: int) -> DataFrame:
    """Rows of two kinds: ``(shard, local, lang, word, n)`` of a shard's words, and ``(shard, packed)``, its index."""
    columns = ["shard", "local", "lang", "word", "n", "packed"]

    def apply(batches) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = itertools.count()
        tokens, words, ids = array("i"), {}, itertools.count(1)

        def of(lang: str) -> defaultdict:
            d = words[lang] = defaultdict(ids.__next__)
            d[_END] = 0
            return d

        def flush() -> Iterator[dict[str, list]]:
            nonlocal tokens, words, ids
            k = next(number)
            seq = np.array(tokens, dtype=np.int32)
            tokens = array("i")
            total = next(ids)
            if k >> _SHARD_BITS or total >> _LOCAL_BITS or part >> 63 - _SHARD_BITS - _LOCAL_BITS:
                raise ValueError("shard numbers are used up; use larger shards or fewer partitions")
            shard = part << _SHARD_BITS | k
            keep = np.ones(len(seq), dtype=bool)
            keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
            seq = seq[keep]
            counts = np.bincount(seq, minlength=total)
            # the words go before the index is built, which needs the most memory
            while words:
                lang, d = words.popitem()
                entries = ((w, i) for w, i in d.items() if i)
                while some := list(itertools.islice(entries, _AT_ONCE)):
                    size = len(some)
                    local = [i for _, i in some]
                    yield {"shard": [shard] * size, "local": local, "lang": [lang] * size, "word": [w.decode("utf-8") for w, _ in some],
                           "n": counts[local], "packed": [None] * size}
                del d, entries
            ids = itertools.count(1)
            yield {"shard": [shard], "local": [None], "lang": [None], "word": [None], "n": [None], "packed": [build(seq)]}

        for langs, texts in batches:
            for lang, text in zip(langs, texts):
                found = text.translate(_TABLE).replace(_END, b" \xff ").split()
                found.append(_END)
                at = 0
                while at < len(found):
                    end = at + max(shard_words - len(tokens), 1)
                    end = found.index(_END, end) + 1 if end < len(found) else len(found)
                    tokens.extend(map((words.get(lang) or of(lang)).__getitem__, found[at:end]))
                    at = end
                    if len(tokens) >= shard_words:
                        yield from flush()
        if tokens:
            yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kinds = ("long", "int", "string", "string", "long", "binary")
    return cut_lineage(map_rows(rows, list(zip(columns, kinds)), apply))


def _in_parts(columns, names: list[str]) -> pa.Table:
    """A table of long columns whose parts are small, as each part is sent and held as one batch."""
    table = pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)
    return pa.Table.from_batches(table.to_batches(max_chunksize=_AT_ONCE), table.schema)


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of known words of one shard; ``right`` is the shard's (local, gid)."""
    names = ["code", "x", "y", "n"]
    if not left.num_rows or not right.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    index = Index(left["packed"][0].as_py())
    gid = np.zeros(int(index.first[-1]) + 1, dtype=np.int64)
    known = np.zeros(len(gid), dtype=bool)
    local = right["local"].to_numpy()
    gid[local], known[local] = right["gid"].to_numpy(), True
    slot, x, y, n = index.pairs(known)
    code = (left["shard"][0].as_py() << _LOCAL_BITS) + slot.astype(np.int64)
    return _in_parts((code, gid[x], gid[y], n), names)


def _triples(left: pa.Table, right: pa.Table) -> pa.Table:
    """All triples of one shard whose pairs are among ``right`` (slot, pid)."""
    names = ["p", "q", "n"]
    if not left.num_rows or not right.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    index = Index(left["packed"][0].as_py())
    pid = np.zeros(len(index.starts), dtype=np.int64)
    live = np.zeros(len(index.starts), dtype=bool)
    slot = right["slot"].to_numpy()
    pid[slot], live[slot] = right["pid"].to_numpy(), True
    a, b, n = index.triples(live)
    return _in_parts((pid[a], pid[b], n), names)


def _named(rows: DataFrame, values: list[str], least: int, name: str) -> DataFrame:
    """``(code, name, ...)`` of the rows (code, n, ...) whose ``values`` occur ``least`` times in all shards.

    The smallest code of equal values is their name. Its row alone has the values and their sum as ``total``.
    """
    same = Window.partitionBy(*values)
    found = rows.withColumns({"total": F.sum("n").over(same), name: F.min("code").over(same)}).filter(F.col("total") >= least)
    first = F.col("code") == F.col(name)
    return cut_lineage(found.select("code", name, *[F.when(first, F.col(v)).alias(v) for v in (*values, "total")]))


def ngrams(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words, pairs and triples of words that occur at least ``least`` times, counted by language, and words by language.

    ``(gid, lang, word, n)``, ``(pid, x, y, n)``, ``(p, q, n)`` and ``(lang, total)``: x and y
    are gids, p and q the pids of a triple's first and last two words. A gid names a word of one language. Counts are sums over shards.
    A pair can only be frequent if both words are, and a triple if both pairs
    are, so each shard extends only the intervals that survived the sum.
    Groups that meet in one task have one row for each shard at most.
    """
    shards = _shards(docs, shard_words)
    indexes = shards.filter("packed is not null").select("shard", "packed")
    vocabulary = shards.filter("packed is null").drop("packed")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    shard, place = F.shiftright("code", _LOCAL_BITS), F.col("code").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    known = _named(vocabulary.select((F.shiftleft("shard", _LOCAL_BITS) + F.col("local")).alias("code"), "lang", "word", "n"), ["lang", "word"], least, "gid")
    words = known.filter("code = gid").select("gid", "lang", "word", F.col("total").alias("n"))
    by_shard = indexes.groupBy("shard")
    spelled = known.select(shard.alias("shard"), place.cast("int").alias("local"), "gid")
    found = by_shard.cogroup(spelled.groupBy("shard")).applyInArrow(_pairs, "code long, x long, y long, n long")
    frequent = _named(found, ["x", "y"], least, "pid")
    pairs = frequent.filter("code = pid").select("pid", "x", "y", F.col("total").alias("n"))
    live = frequent.select(shard.alias("shard"), place.cast("int").alias("slot"), "pid")
    triples = by_shard.cogroup(live.groupBy("shard")).applyInArrow(_triples, "p long, q long, n long")
    triples = triples.groupBy("p", "q").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words, pairs, cut_lineage(triples), totals


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"cast({wide(a)} * {wide(a)} * 1000000BD as decimal(38,0)) div ({wide(left)} * {wide(right)})").cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` phrases of two or three words of every language of ``docs`` (lang, text).

    Gives lang, rank, phrase, a, l, r, n, score. Null languages are ``und``,
    null and empty texts have no words, repeated rows count each, other
    columns are ignored, an empty table gives no rows. Ranks go by score and a,
    both descending, then by the phrase's bytes, so there are no ties. Long
    texts are spread over shards at ends of pieces. Scores are exact while
    1000000 * a * a has at most 38 digits; beyond that Spark raises an error.
    """
    words, pairs, triples, totals = ngrams(docs, least, shard_words)
    word = lambda g, *more: words.select(F.col("gid").alias(g), *more)
    three = (
        triples.withColumnRenamed("n", "a")
        .join(pairs.select(F.col("pid").alias("p"), "x", "y", F.col("n").alias("xy")), "p")
        .join(pairs.select(F.col("pid").alias("q"), F.col("y").alias("z"), F.col("n").alias("yz")), "q")
        .join(word("x", "lang", F.col("word").alias("w1"), F.col("n").alias("n1")), "x")
        .join(word("y", F.col("word").alias("w2")), "y")
        .join(word("z", F.col("word").alias("w3"), F.col("n").alias("n3")), "z")
        .withColumns({"early": _score("a", "n1", "yz"), "late": _score("a", "xy", "n3")})
        .withColumn("first", F.col("early") <= F.col("late")))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(F.col("first"), F.col("n1")).otherwise(F.col("xy")).alias("l"),
                         F.when(F.col("first"), F.col("yz")).otherwise(F.col("n3")).alias("r"), F.least("early", "late").alias("score"))
    inside = triples.select(F.explode(F.array("p", "q")).alias("pid"), "n").groupBy("pid").agg(F.max("n").alias("longer"))
    two = (
        pairs.withColumnRenamed("n", "a").join(inside, "pid", "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        .join(word("x", "lang", F.col("word").alias("w1"), F.col("n").alias("l")), "x")
        .join(word("y", F.col("word").alias("w2"), F.col("n").alias("r")), "y")
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = top_n_per_group(two.unionByName(three), ["lang"], order, top, F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


COLLOCATIONS_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM split, (VALUES (1), (2), (3)) v(k)),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 10),
halves AS MATERIALIZED (
  SELECT *, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, p.f AS l, q.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM halves c JOIN counts p ON p.lang = c.lang AND p.phrase = c.head JOIN counts q ON q.lang = c.lang AND q.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS a FROM (
    SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS inner_phrase, a FROM candidates WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN longer g ON w.k = 2 AND g.lang = w.lang AND g.inner_phrase = w.phrase
  WHERE g.a IS NULL OR 100 * g.a < 50 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
