"""Quality rules whose verdict is taken per host."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, group_key, map_rows, type_of, utf8

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
#: Rules a document may break; a host is judged by the share of its documents that break each.
RULES = ("base", "symbols", "lines", "lengths")
#: A host whose shrunk failure rate in any rule reaches REJECT loses all documents;
#: from STRICT on it loses those that break that rule themselves.
REJECT, STRICT = 0.6, 0.3
#: Bounds of the prior's weight in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0
_SYMBOLS = b"#*$%&|<>"


def _measure(batches):
    gaps = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
    for ids, hosts, texts in batches:
        out = {k: [] for k in ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        out["doc_id"], out["host"] = ids, hosts
        for text in texts:
            words = text.split()  # bytes split at the six ASCII white space characters
            n = len(words)
            out["n_words"].append(n)
            # bytes that are no continuation bytes are code points
            points = len(text.decode("utf-8", "replace"))
            out["word_chars"].append(points - sum(map(text.count, gaps)))
            out["n_symbols"].append(len(text) - len(text.translate(None, _SYMBOLS)))
            lines = text.split(b"\n")
            worded = [x for x in lines if x and not x.isspace()] if len(lines) > 1 else lines[:0]
            out["n_dup_lines"].append(len(worded) - len(set(worded)))
            out["n_repeat_words"].append(_repeated(words))
        yield out


def _repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first, hit = {}, set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit.add(j)
            hit.add(i)
    covered = set(hit)
    covered.update(i + 1 for i in hit)
    covered.update(i + 2 for i in hit)
    return len(covered)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of every whole text of ``docs``; a null text has no words."""
    return map_rows(
        docs.select("doc_id", group_key(host).alias("host"), utf8().alias("text")),
        [("doc_id", type_of(docs, "doc_id")), ("host", "string"), ("n_words", "long"), ("word_chars", "long"),
         ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")],
        _measure)


def with_failures(measured: DataFrame) -> DataFrame:
    """One column ``fails_<rule>`` per rule."""
    n = F.col("n_words")
    return measured.withColumns({
        "fails_base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n),
        "fails_symbols": 5 * F.col("n_symbols") > n,
        "fails_lines": 5 * F.col("n_dup_lines") > n,
        "fails_lengths": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    })


def host_verdicts(failures: DataFrame) -> DataFrame:
    """``host``, documents, and per rule the shrunk failure rate.

    The prior of a rule is the beta distribution whose mean is the failure rate
    of all documents and whose variance is that of the hosts' rates, weighted
    by their documents, less what rates differ by chance alone: each host's
    sampling variance, with these weights, sums to ``hosts * m * (1 - m) / documents``.
    A host's rate is the posterior mean. With one host, or rates that differ
    by no more than chance, the prior has the weight MOST_PRIOR.
    """
    hosts = cut_lineage(failures.groupBy("host").agg(
        F.count("*").alias("n"), *[F.count_if(f"fails_{r}").alias(f"f_{r}") for r in RULES]))
    n = F.col("n")
    means = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *[(F.sum(f"f_{r}") / F.sum("n")).alias(r) for r in RULES]).first()
    spread = hosts.agg(*[
        (F.sum(n * F.pow(F.col(f"f_{r}") / n - F.lit(means[r] or 0.0), 2)) / F.sum("n")).alias(r) for r in RULES]).first()
    columns = {}
    for r in RULES:
        m = means[r] or 0.0
        v = (spread[r] or 0.0) - (means["hosts"] / means["n"] if means["n"] else 0.0) * m * (1 - m)
        weight = MOST_PRIOR if v <= 1e-12 else min(MOST_PRIOR, max(LEAST_PRIOR, m * (1 - m) / v - 1))
        columns[f"rate_{r}"] = (F.col(f"f_{r}") + F.lit(m * weight)) / (n + F.lit(weight))
    return hosts.withColumns(columns)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, ``host``, text).

    Texts are read once; failures are counted per host with partial sums before
    the shuffle, and the hosts' verdicts are joined back to the narrow rows, a
    join that Spark splits where a host is hot. Null hosts are one host, null
    texts have no words (and fail), repeated rows are judged like any other,
    other columns are ignored, an empty table gives no rows.
    """
    rows = cut_lineage(with_failures(measures(docs, host)))
    verdicts = host_verdicts(rows)
    rejected = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) >= REJECT
    hosts = verdicts.select("host", rejected.alias("host_rejected"), *[(F.col(f"rate_{r}") >= STRICT).alias(f"strict_{r}") for r in RULES])
    against = F.lit(False)
    for r in RULES:
        against = against | (F.col(f"strict_{r}") & F.col(f"fails_{r}"))
    return rows.join(hosts, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("fails_base").alias("base_failed"), "host_rejected",
        (~F.col("fails_base") & ~F.col("host_rejected") & ~against).alias("kept"))


def _sql() -> str:
    space = r"[^\x20\x09-\x0D]+"
    rate = []
    for r in RULES:
        rate.append(f"""(f_{r} + m_{r} * k_{r}) / (n + k_{r}) as rate_{r}""")
    weight = ", ".join(
        f"case when v_{r} <= 1e-12 then {MOST_PRIOR} else least({MOST_PRIOR}, greatest({LEAST_PRIOR}, m_{r} * (1 - m_{r}) / v_{r} - 1)) end as k_{r}"
        for r in RULES)
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce('=' || source, '-') host, coalesce(text, '') text from documents),
w as (select rid, doc_id, host, text, regexp_extract_all(text, '{space}') ws from d),
g as (select rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] gram from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) c from g) where c > 1),
cov as (select rid, count(distinct i + o) n_repeat_words from rep, (values (0), (1), (2)) t(o) group by rid),
ln as (select rid, sum(c - 1) n_dup_lines from (select rid, line, count(*) c from
  (select rid, unnest(string_split(text, chr(10))) line from w) where regexp_matches(line, '{space}') group by all) group by rid),
m as (select doc_id, host, len(ws) n_words, length(array_to_string(ws, ''))::bigint word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words
  from w left join cov using (rid) left join ln using (rid)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words fails_base, 5 * n_symbols > n_words fails_symbols,
  5 * n_dup_lines > n_words fails_lines, word_chars < 2 * n_words or word_chars > 20 * n_words fails_lengths from m),
h as (select host, count(*) n, {", ".join(f"count_if(fails_{r}) f_{r}" for r in RULES)} from f group by host),
p as (select {", ".join(f"sum(f_{r}) / sum(n) m_{r}" for r in RULES)} from h),
q as (select {", ".join(f"any_value(m_{r}) m_{r}, sum(n * (f_{r} / n - m_{r}) ** 2) / sum(n) - count(*) / sum(n) * any_value(m_{r}) * (1 - any_value(m_{r})) v_{r}" for r in RULES)} from h, p),
k as (select *, {weight} from q),
v as (select host, {", ".join(rate)} from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_base as base_failed,
  greatest({", ".join(f"rate_{r}" for r in RULES)}) >= {REJECT} as host_rejected,
  not fails_base and greatest({", ".join(f"rate_{r}" for r in RULES)}) < {REJECT}
  and not ({" or ".join(f"rate_{r} >= {STRICT} and fails_{r}" for r in RULES)}) as kept
from f join v using (host)
"""


JUDGE_SQL = _sql()
