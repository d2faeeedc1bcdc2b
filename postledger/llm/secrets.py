"""Secret scans kept in a ledger of content-addressed blobs."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, group_key
from .spans import Search, digest, located, of_kind


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of its group (0: the match). A changed rule gets a new version."""

    name: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    # a match of 18 or more characters starts where the whole run starts, so the bound can be in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
)
#: Further public key formats.
MORE = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", 1, r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE
LEDGER = "blob binary, done array<string>, findings array<struct<rule:string,kind:string,start:bigint,end:bigint>>"


def address(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows for ``versions`` (path, text): every historical version of every path.

    Versions are named by the SHA-256 of their text. A blob is scanned once,
    whatever the number of its paths, and only by those rule versions that no
    row of ``ledger`` lists for it. A ledger row has the blob, the rule
    versions done, and the findings (rule version, kind, start, end in code
    points). Only one version of each pending blob brings its text along; a
    blob that is hot among the versions spreads over its paths. Null texts are
    empty, null paths are a path of their own, other columns are ignored,
    without pending pairs no rows come back.
    """
    spark = versions.sparkSession
    ledger = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    every = F.array(*[F.lit(r.key) for r in rules])
    named = versions.select(group_key("path").alias("path"), address().alias("blob"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
    pending = (
        named.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
        .select("blob", "path", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("pending"))
        .filter(F.size("pending") > 0)
    )
    texts = versions.select(group_key("path").alias("path"), address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    # a path can hold the same text in several versions
    fetched = texts.join(pending, ["blob", "path"]).select("blob", "pending", "text").withColumn("row", F.monotonically_increasing_id())
    found = located(fetched, "row", [
        Search(r.key, r.pattern, r.group, F.array_contains("pending", r.key)) for r in rules])
    keep = F.lit(False)
    for r in rules:
        keep = keep | ((F.col("kind") == r.key) & (F.length("inner") >= r.least))
    finding = F.when(keep, F.struct(
        F.col("kind").alias("rule"), F.substring_index("kind", "@", 1).alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return cut_lineage(found.groupBy("blob").agg(F.any_value("pending").alias("done"), F.collect_set(finding).alias("findings")))


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``versions`` (path, text) with blob and the findings of ``rules`` from the ledger, an empty list where there are none."""
    current = F.array(*[F.lit(r.key) for r in rules])
    # written, so that both sides of the join are plain shuffles and Spark can split a blob with very many paths
    known = cut_lineage(ledger.filter(F.size("findings") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings")))
    rows = versions.select("path", address().alias("blob"))
    none = F.array().cast("array<struct<rule:string,kind:string,start:bigint,end:bigint>>")
    return rows.join(known, "blob", "left").select("path", "blob", F.filter(
        F.coalesce("findings", none), lambda f: F.array_contains(current, f["rule"])).alias("findings"))


def digests(found: DataFrame) -> DataFrame:
    """path, counts of the base kinds, digest of the base findings and all findings as text."""
    base = tuple(r.name for r in BASE)
    kinds = tuple(r.name for r in RULES)
    own = F.filter("findings", lambda f: f["kind"].isin(*base))
    return found.select(
        "path", *[of_kind(own, k).alias(f"n_{k}") for k in base],
        F.sha2(digest(own, base), 256).alias("base_sha256"), digest(F.col("findings"), kinds).alias("spans"))


def _sql() -> str:
    """The result of scanning everything once, stated by regular expressions over all texts."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    # the possessive forms match the same texts as the greedy ones
    rules = ", ".join(f"({n}, {quote(r.name)}, {quote(r.pattern.replace('}+', '}'))}, {r.least}, {r.group})" for n, r in enumerate(RULES))
    inner = " ".join(f"WHEN {quote(r.name)} THEN length(regexp_extract(m, {quote(r.pattern.replace('}+', '}'))}, {r.group}))" for r in RULES if r.group)
    base = ", ".join(quote(r.name) for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quote(r.name)}) AS n_{r.name}" for r in BASE)
    shown = "string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k(rank, kind, pat, least, grp) AS (VALUES {rules}),
a AS (SELECT rid, rank, kind, least, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS gs FROM d, k WHERE regexp_matches(t, pat)),
u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM a),
f AS (SELECT rid, rank, kind, least, ms[i] AS m, length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS s FROM u),
g AS (SELECT * FROM f WHERE CASE kind {inner} ELSE length(m) END >= least),
r AS (SELECT rid, {counts}, sha256(coalesce({shown} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, {shown} AS spans FROM g GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{x.name}, 0) AS n_{x.name}" for x in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (rid)"""


SCAN_SQL = _sql()
