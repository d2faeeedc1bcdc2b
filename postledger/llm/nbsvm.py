"""Quality classifier: naive Bayes log-count ratios as scales of a linear support vector machine."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_BATCH, cut_lineage, map_rows, small_batches, type_of, utf8

#: Hashed n-grams; tables of this many weights are the only ones the driver gets.
BUCKETS = 1 << 18
#: At most so many labelled rows, by hash order, fit the machine; the log-count ratios count all labelled rows.
SAMPLE = 8000
EPOCHS = 12
COST = 1.0
BLEND = 0.5  # part of the fitted weights against their mean size, as in the published method
THRESHOLD = 0.3
FOLDS = 5
_MEMO = 100_000


def form(word: str) -> str:
    """The word's outline: letters as a, capitals as A, digits as 9, other characters as they are, runs cut at two."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


class Grams:
    """Hashed n-grams of texts: words, and pairs of neighbouring outlines with a mark where the word repeats."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh32_intdigest
        self.words: dict[bytes, tuple[int, str]] = {}
        self.pairs: dict[tuple[str, str], int] = {}

    def of(self, text: bytes) -> list[int]:
        words, known = text.split(), self.words
        if len(known) > _MEMO:
            known.clear()
        # equal neighbours are looked up before the words become a set
        same = {a for a, b in zip(words, words[1:]) if a == b}
        for w in set(words):
            if w not in known:
                known[w] = (self.digest(w.lower()) % BUCKETS, form(w.decode("utf-8", "replace")))
        found = {known[w][0] for w in set(words)}
        outlines = [known[w][1] for w in words]
        grams = set(zip(outlines, outlines[1:]))
        grams.update(("same", known[w][1]) for w in same)
        grams.update(("one", x) for x in set(outlines))
        if len(self.pairs) > _MEMO:
            self.pairs.clear()
        for g in grams:
            at = self.pairs.get(g)
            if at is None:
                at = self.pairs[g] = self.digest(f"{g[0]}\x00{g[1]}".encode(), 1) % BUCKETS
            found.add(at)
        return sorted(found)


def grams(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct hashed n-grams of every whole text."""
    def rows_of(batches):
        own = Grams()
        for ids, texts in batches:
            yield {"doc_id": ids, "grams": [np.array(own.of(t), dtype=np.int32) for t in texts]}

    return map_rows(docs.select("doc_id", utf8().alias("text")), [("doc_id", type_of(docs, "doc_id")), ("grams", "array<int>")], rows_of)


def fold(doc_id: str = "doc_id"):
    """0 for held-out rows, 1 to FOLDS - 1 for those that may be learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[values], dtype=np.float64)])
        n = np.diff(offsets)
        margin = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int,
                            costs: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the linear machine with hinge loss; row i has ``values[i]`` at places ``rows[i]``."""
    w = np.zeros(size)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            gradient = signs[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), costs[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                alpha[i] = new
    return w


def _sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton steps with smoothed labels."""
    pos, neg = good.sum(), (~good).sum()
    target = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margins) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float(h @ margins**2) + 1e-3, float(h @ margins), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = max(1.0, abs(da) / 5, abs(db) / 5)
        a, b = a - da / scale, b - db / scale
    return max(a, 1e-3), b


def fit(featured: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Machine from the labelled rows outside the held-out fold.

    The log-count ratios come from counts over all such rows. The hinge loss is
    minimised over at most ``sample`` of them in hash order; the last fifth of
    these sets the logistic curve. Without rows of both labels all scores are
    the share of label 1, or 0.5 without any.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y"))
    # always a sorted join, so that what is shuffled grows in proportion
    rows = cut_lineage(featured.join(known.hint("merge"), "doc_id").select("y", "grams", F.xxhash64(F.col("doc_id").cast("string")).alias("h")))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = 0.5 if not totals else float(next(iter(totals)))
        return Machine(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((share + 0.01) / (1.01 - share))))
    counts = rows.select("y", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.sum("y").alias("good"), F.count("*").alias("n")).toArrow()
    at = counts["gram"].to_numpy()
    good, every = np.ones(BUCKETS), np.full(BUCKETS, 2.0)
    good[at] += counts["good"].to_numpy()
    every[at] += counts["n"].to_numpy()
    bad = every - good
    ratio = np.log(good / (totals[1] + 2)) - np.log(bad / (totals[0] + 2))

    # the hash of the last row of the sample is found on hashes alone
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    part = rows.filter(F.col("h") <= last).sort("h", "grams").limit(sample).toArrow()
    offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(part["grams"]).to_numpy())])
    flat = part["grams"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if part.num_rows else np.zeros(0, dtype=int)
    y = part["y"].to_numpy() == 1
    n = len(y)
    cut = n - n // 5 if n >= 50 else n
    scaled = np.append(ratio, 1.0)
    # rows are views of two arrays; the bias is the last place of each
    sizes = np.diff(offsets)
    at = np.arange(len(flat)) + np.repeat(np.arange(n), sizes)
    place, value = np.full(len(flat) + n, BUCKETS, dtype=np.int32), np.ones(len(flat) + n)
    place[at], value[at] = flat, ratio[flat] / np.sqrt(np.repeat(sizes, sizes))
    places, values = (np.split(x, offsets[1:-1] + np.arange(1, n)) for x in (place, value))
    share = max(y[:cut].mean(), 1e-6)
    costs = np.where(y, COST * 0.5 / share, COST * 0.5 / max(1 - share, 1e-6))
    w = dual_coordinate_descent(places[:cut], values[:cut], np.where(y, 1.0, -1.0)[:cut], BUCKETS + 1, costs[:cut])
    weights = w[:-1]
    used = weights[np.abs(weights) > 1e-9]  # others have cancelled out but for rounding
    mean = float(np.abs(used).mean()) if len(used) else 0.0
    machine = Machine(((1 - BLEND) * mean + BLEND * weights) * scaled[:-1], float(w[-1]), 1.0, 0.0)
    sums = np.concatenate([[0.0], np.cumsum(machine.weights[flat])])
    margins = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(np.diff(offsets), 1)) + machine.bias
    held = slice(cut, n) if cut < n and y[cut:].any() and not y[cut:].all() else slice(0, n)
    machine.slope, machine.shift = _sigmoid(margins[held], y[held])
    return machine


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Texts are read once: their hashed n-grams are written and serve counting,
    fitting and scoring. ``labels`` has (doc_id, ``label``); labels other than
    0 and 1 and rows without doc_id are not learned from, of repeated labels
    the larger counts. Null and empty texts have no n-gram and get the score of
    the machine's bias. Repeated rows are scored each, other columns are
    ignored, an empty table gives no rows.
    """
    featured = cut_lineage(grams(docs))
    machine = docs.sparkSession.sparkContext.broadcast(fit(featured, labels, label))  # BUCKETS numbers
    kind = type_of(docs, "doc_id")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64())])

    def apply(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.value.scores(offsets, values))], schema=schema)

    scored = featured.select("doc_id", "grams").mapInArrow(apply, f"doc_id {kind.simpleString()}, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, judged row by row, with all their columns.

    Nulls count as empty texts, which have the score of the machine's bias. Rows
    with one text are judged alike, repeated rows and rows without doc_id each
    for themselves. Whole texts are scored. Columns of any name pass through;
    an empty table gives no rows.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(cut_lineage(grams(docs)), labels, label))
    at = docs.columns.index("text")

    def apply(batches):
        own = Grams()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                found = [np.array(own.of((t.as_py() or "").encode("utf-8")), dtype=np.int32) for t in part.column(at)]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
                values = np.concatenate(found)
                yield part.filter(pa.array(machine.value.scores(offsets, values) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(apply, docs.schema)
