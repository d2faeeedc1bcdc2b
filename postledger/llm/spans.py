"""Places of pattern matches in texts, with column functions only."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters kept on either side of a match as its context.
CONTEXT = 80


@dataclass(frozen=True)
class Search:
    """A pattern to find; ``when`` is a cheap test that every text with a match passes."""

    kind: str
    pattern: str
    group: int = 0
    when: Column | None = None


def _end_of(gap: Column, words: int) -> Column:
    """The last words of a stretch, with white space as single characters."""
    return F.substring_index(F.translate(gap, "\t\n\x0b\x0c\r", "     "), " ", -2 * words)


def _start_of(gap: Column, words: int) -> Column:
    return F.substring_index(F.translate(gap, "\t\n\x0b\x0c\r", "     "), " ", 2 * words)


def located(df: DataFrame, key: str, searches: list[Search], words: int = 0) -> DataFrame:
    """One row per leftmost non-overlapping match of each search in column ``text``.

    Columns: those of ``df`` but the text, kind, value (the match), inner (its
    group), left and right (context), start and end (code points, end
    exclusive). With ``words`` the context is so many whole words at least on either side, whatever
    search found what stands there; else it is a stretch of characters up to the next match. Rows without a match stay, with null kind. A match's place is
    the sum of the lengths of all earlier matches and of the stretches between
    them, which come from splitting the text by the same pattern; ``key`` must
    tell rows apart. Texts without a match are tested once and not split.
    """
    keep = [c for c in df.columns if c != "text"]
    text = F.col("text")
    # separate projections, so that no regular expression is run again for each of its uses
    hits = df.select(*keep, "text", *[
        (F.regexp_like(text, F.lit(s.pattern)) if s.when is None else s.when & F.regexp_like(text, F.lit(s.pattern))).alias(f"_hit{n}")
        for n, s in enumerate(searches)])
    columns = []
    for n, s in enumerate(searches):
        hit = F.col(f"_hit{n}")
        columns.append(F.when(hit, F.split(text, s.pattern, -1)).alias(f"_gaps{n}"))
        columns.append(F.when(hit, F.regexp_extract_all(text, F.lit(s.pattern), F.lit(0))).alias(f"_found{n}"))
        if s.group:
            columns.append(F.when(hit, F.regexp_extract_all(text, F.lit(s.pattern), F.lit(s.group))).alias(f"_inner{n}"))
    split = hits.select(*keep, *columns)

    def each(n: int, s: Search) -> Column:
        gaps, found = F.col(f"_gaps{n}"), F.col(f"_found{n}")
        inner = F.col(f"_inner{n}") if s.group else found
        nothing = F.lit("")

        def near(i: Column, m: Column) -> tuple[Column, Column]:
            if not words:
                return F.substring(m["gap"], -CONTEXT, CONTEXT), F.substring(m["rest"], 1, CONTEXT)
            # a match between two stretches is a word at least, so as many matches as words are enough
            left, right = [_end_of(m["gap"], words)], [_start_of(m["rest"], words)]
            for k in range(1, words + 1):
                left[:0] = [_end_of(F.coalesce(F.get(gaps, i - k), nothing), words), F.coalesce(F.get(found, i - k), nothing)]
                right += [F.coalesce(F.get(found, i + k), nothing), _start_of(F.coalesce(F.get(gaps, i + k + 1), nothing), words)]
            return F.concat(*left), F.concat(*right)

        rows = F.arrays_zip(found.alias("value"), inner.alias("inner"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("rest"))
        structs = F.transform(rows, lambda m, i: F.struct(
            F.lit(s.kind).alias("kind"), i.alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["value"]).alias("size"), m["value"].alias("value"),
            m["inner"].alias("inner"), near(i, m)[0].alias("left"), near(i, m)[1].alias("right")))
        # there is one stretch more than matches
        return F.when(gaps.isNotNull(), F.slice(structs, F.lit(1), F.size(found)))

    none = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:string,inner:string,left:string,right:string>>")
    every = F.flatten(F.array(*[F.coalesce(each(n, s), none) for n, s in enumerate(searches)]))
    rows = split.select(*keep, F.explode_outer(every).alias("m")).select(*keep, "m.*").repartition(key)
    order = Window.partitionBy(key, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("gap", "size", "i")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of structs (kind, start, end), by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].cast("long").alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].cast("long").alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
