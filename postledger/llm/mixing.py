"""Mixing of sources to target weights by Poisson replication."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .common import cut_lineage, group_key

#: Without given targets a source weighs as this power of its number of rows.
TEMPER = 0.5
SEED = 17
#: Larger mean rates are drawn as a sum of parts, as exp(-rate) would vanish.
LARGEST_PART = 512


def _bits(*parts: Column | str | int) -> Column:
    """52 bits from the MD5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def poisson(rate: Column, uniform: Column) -> Column:
    """Inverse of the Poisson distribution: how many values of its distribution function are at most ``uniform``."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["c"] <= uniform, F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + 1).alias("k"))).otherwise(s)

    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def source_rates(docs: DataFrame, targets: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``(source_key, rate)``: mean number of copies of each row of a source.

    ``targets`` has (source, weight); sources without a positive weight get
    rate 0. Without ``targets`` the weight is ``rows ** TEMPER``. ``total`` is
    the wanted number of rows, by default as many as there are.
    """
    counts = docs.groupBy(group_key("source").alias("source_key")).agg(F.count("*").alias("n"))
    if targets is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPER)))
    else:
        wanted = targets.groupBy(group_key("source").alias("source_key")).agg(F.sum("weight").cast("double").alias("w"))
        weighed = counts.join(wanted, "source_key", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    weighed = cut_lineage(weighed)
    n, w = weighed.agg(F.sum("n"), F.sum("w")).first()
    goal = float(total if total is not None else n or 0)
    rate = F.lit(goal) * F.col("w") / F.lit(w or 1.0) / F.col("n")
    return weighed.select("source_key", rate.alias("rate"))


def mix(docs: DataFrame, targets: DataFrame | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, ...) zero or more times, in a global random order.

    The number of copies is drawn from the Poisson distribution whose mean is
    the source's rate, by inversion at a hash of (seed, doc_id): the result
    does not depend on the order, partitioning or attempt. Rows that repeat a
    doc_id share its draw. Null sources are one source; a null doc_id hashes as
    such. The result has all columns of ``docs`` and ``copy_no`` (from 1) and
    ``shuffle_key``, which replace columns of those names. Rows are dealt to
    partitions by ``shuffle_key`` and sorted by it inside them. An empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    rates = source_rates(docs, targets, total)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    parts = F.greatest(F.ceil(F.col("_rate") / F.lit(LARGEST_PART)), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(0), parts - 1), F.lit(0),
        lambda s, i: s + poisson(F.col("_rate") / parts, _bits(seed, named, i) / F.lit(float(1 << 52))))
    copies = (
        salted_join(docs.select(*names).withColumn("_source", group_key("source")),
                    rates.select(F.col("source_key").alias("_source"), F.col("rate").alias("_rate")), ["_source"], "inner", named)
        .withColumn("_copies", drawn).filter("_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("shuffle_key", _bits(seed + 1, named, F.col("copy_no")))
    )
    return copies.select(*names, "copy_no", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")


MIX_SQL = f"""
with c as (select source, count(*)::double n, count(*)::double ** {TEMPER} w from documents group by source),
r as (select source, (select sum(n) from c) * w / (select sum(w) from c) / n as rate from c),
q as (select source, rate / parts as rate, parts from (select *, greatest(ceil(rate / {LARGEST_PART}), 1)::bigint as parts from r)),
terms as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::bigint)) i from q),
cdf as (select source, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) over (partition by source order by i) f from terms),
j as (select d.*, unnest(range(0, q.parts)) part from documents d join q on q.source is not distinct from d.source),
d as (select *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, 'null') || '|' || part), 1, 13))::bigint / 4503599627370496.0 u from j),
k as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(cdf.i)::int copies
  from d join cdf on cdf.source is not distinct from d.source and cdf.f <= d.u group by all)
select doc_id, text, lang, source, n_chars, copy_no::int as copy_no,
  ('0x' || substr(md5('{SEED + 1}|' || coalesce(doc_id::varchar, 'null') || '|' || copy_no), 1, 13))::bigint as shuffle_key
from (select k.*, unnest(range(1, copies + 1)) copy_no from k)
"""
