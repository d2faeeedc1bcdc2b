"""Personal data: fixed patterns as seeds, and contexts learned from them that find further identifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, type_of
from .spans import Search, digest, located, of_kind

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the seed patterns, with starts only where a run of their first
#: characters starts (or the last match ended): the same matches, in linear time and constant stack.
SEEDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A possible identifier begins the text or follows white space, a label or a bracket, and ends before the like.
_FROM = r"""(?<![^\x20\t-\r:=(\[<"'])"""
_TO = r"""(?![^\x20\t-\r,;.:!?)\]>"'])"""
#: What may be an identifier where only its context names it: groups of digits with single separators or
#: brackets between them, words with @, and groups of hexadecimal digits with colons.
POSSIBLE = {
    "number": rf"{_FROM}\(?[0-9]++\)?(?:[\x20./-]?\(?[0-9]++\)?|\)\x20[0-9]++)*+{_TO}",
    "address": rf"{_FROM}[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?{_TO}",
    "hex": rf"{_FROM}(?:[0-9A-Fa-f]{{1,4}}:){{3,7}}[0-9A-Fa-f]{{1,4}}{_TO}",
}
#: A context is trusted with so many different known identifiers, and from such a share of its known and contradicting ones on.
SUPPORT = 3
TRUST = 0.7
#: An identifier is accepted from this confidence on.
ACCEPT = 0.7
ROUNDS = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (
        (kind == "email")
        | ((kind == "ip") & F.regexp_like(value, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")))
        | ((kind == "card") & n.between(14, 19) & F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False))
        | ((kind == "phone") & n.between(10, 15))
    )


def _looks(kind: Column, value: Column) -> Column:
    """The kind that a possible identifier may be of, by its form; null if of none."""
    n = F.length(_digits(value))
    dotted = F.regexp_like(value, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$"))
    return (
        F.when(kind == "address", "email").when(kind == "hex", "ip")
        .when((kind == "number") & dotted, F.when(F.regexp_like(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")), "ip"))
        .when((kind == "number") & n.between(14, 19) & F.regexp_like(value, F.lit(r"^[0-9\x20-]+$")), "card")
        .when((kind == "number") & n.between(7, 13), "phone"))


def mentions(docs: DataFrame) -> DataFrame:
    """row, doc_id and all valid seeds and possible identifiers of every whole text, with their contexts.

    Possible identifiers of no kind, as numbers that are too short, are kept as
    kind ``none``: they contradict the contexts they stand in. Rows without any
    mention stay with a null kind. The contexts are the two words before, the words on either side, the
    label before, and the words before a label that touches the identifier.
    Words with digits or @ are alike in them, so that lists of identifiers have contexts.
    """
    text = F.col("text")
    before = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "address": F.contains(text, F.lit("@")),
              "hex": F.regexp_like(text, F.lit("[0-9A-Fa-f]:[0-9A-Fa-f]"))}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = located(rows, "row", [Search(k, p, when=before.get(k)) for k, p in {**SEEDS, **POSSIBLE}.items()], words=2)
    seed = F.col("kind").isin(*KINDS) & valid(F.col("kind"), F.col("value"))
    possible = F.col("kind").isin(*POSSIBLE)
    found = found.withColumn("seed", F.coalesce(seed, F.lit(False))).withColumn(
        "kind", F.when(seed, F.col("kind")).when(possible, F.coalesce(_looks(F.col("kind"), F.col("value")), F.lit("none"))))
    # what a seed overlaps is no candidate: look at the seeds that start before and after it
    at = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.when(F.col("seed"), F.col("end"))).over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy("row").orderBy(F.col("start").desc())
    following = F.min(F.when(F.col("seed"), F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    hidden = ~F.col("seed") & ((F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(following, F.col("end")) < F.col("end")))
    found = found.withColumn("kind", F.when(~hidden, F.col("kind")))
    alike = lambda side: F.transform(F.split(F.lower(F.trim(side)), " +"), lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(w))
    glued = F.regexp_like("left", F.lit(r"[:=(]$"))
    found = found.withColumns({"words": alike(F.col("left")), "after": alike(F.col("right")), "glued": glued})
    last = lambda k: F.get("words", F.size("words") - k)
    w1, w2, w3, bare = last(1), last(2), last(3), F.get("after", F.lit(0))
    contexts = F.array(
        F.when(w1 != "", F.concat_ws(" ", w2, w1, F.lit("_"))),
        F.when((w1 != "") & (bare != ""), F.concat_ws(" ", w1, F.lit("_"), bare)),
        F.when(w1.rlike("[a-z][:=]$"), F.concat_ws(" ", w1, F.lit("_"))),
        F.when(F.col("glued") & (w2 != ""), F.concat_ws(" ", w3, w2, F.lit("_"))))
    return cut_lineage(found.select(
        "row", "doc_id", "kind", "seed", "start", "end", F.lower(F.col("value")).alias("name"), F.array_distinct(F.array_compact(contexts)).alias("contexts")))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """``(kind, name, confidence)`` of the identifiers that only their contexts show.

    The graph links contexts with the different identifiers seen in them. A
    context's trust in a kind is the summed confidence of its identifiers of
    that kind, over the same sum for all kinds and the number of its mentions of
    no kind, plus one. Identifiers that are not known yet speak neither for nor against it. An identifier's
    confidence is one minus the product of the doubts of its trusted contexts.
    Seeds have confidence one; accepted identifiers count in the next round.
    """
    edges = cut_lineage(
        found.filter("kind is not null").select("kind", "name", "seed", F.explode("contexts").alias("context"))
        .groupBy("kind", "context", "name").agg(F.max("seed").alias("seed")))
    known = None
    for _ in range(rounds):
        own = F.when(F.col("seed"), F.lit(1.0))
        if known is None:
            scored = edges.withColumn("confidence", own.otherwise(F.lit(0.0)))
        else:
            scored = edges.join(known, ["kind", "name"], "left").withColumn("confidence", own.otherwise(F.coalesce("confidence", F.lit(0.0))))
        kinds = scored.groupBy("context", "kind").agg(
            F.count_if(F.col("confidence") > 0).alias("n"), F.sum("confidence").alias("mass"), F.count("*").alias("all"))
        whole = kinds.groupBy("context").agg(F.sum(F.when(F.col("kind") == "none", F.col("all")).otherwise(F.col("mass"))).alias("total"))
        contexts = kinds.filter((F.col("kind") != "none") & (F.col("n") >= support)).join(whole, "context").select(
            "context", "kind", (F.col("mass") / (F.col("total") + 1)).alias("trust")).filter(F.col("trust") >= trust)
        doubt = F.exp(F.sum(F.log(1 - F.col("trust"))))
        known = cut_lineage(
            edges.filter(~F.col("seed")).join(contexts, ["kind", "context"]).groupBy("kind", "name").agg((1 - doubt).alias("confidence"))
            .filter(F.col("confidence") >= accept))
    return known


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """doc_id and all spans (kind, start, end, seed) of every row of ``docs`` (doc_id, text).

    Seeds are the valid matches of the fixed patterns. Texts are read once;
    everything else works on the mentions. Null texts are empty, repeated rows
    are reported each, a null doc_id is reported as such, other columns are
    ignored, an empty table gives no rows.
    """
    found = mentions(docs)
    known = bootstrap(found, **how).select("kind", "name", F.lit(True).alias("accepted"))
    seen = found.filter("kind is not null and not seed").join(known, ["kind", "name"], "left_semi")
    span = F.struct("kind", "start", "end", "seed")
    spans = found.select("row", "doc_id", F.when(F.col("seed"), span).alias("s")).unionByName(
        seen.select("row", "doc_id", span.alias("s")))
    return spans.groupBy("row").agg(F.any_value("doc_id").cast(type_of(docs, "doc_id")).alias("doc_id"), F.collect_list("s").alias("spans")).drop("row")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of seeds of each kind, digest of the seeds and all spans as text."""
    seeds = F.filter("spans", lambda s: s["seed"])
    return found.select(
        "doc_id", *[of_kind(seeds, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(digest(seeds, KINDS), 256).alias("base_sha256"), digest(F.col("spans"), KINDS).alias("spans"))
