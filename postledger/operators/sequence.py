"""Line differences in order: what stands in the new text outside the blocks that both texts share in sequence."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut_lineage
from .watch import LINE_END

# --- fixed values: from this many lines on, lines that fill more than a hundredth of the text start no block ---
MANY_LINES = 200
# ------------------------------------------------------------------------------------

_SEGMENT = ["id", "alo", "ahi", "blo", "bhi"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a line end at the very end begins no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _equal_run(length: Column, same) -> Column:
    """How many of the ``length`` places nearest first are the same."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), same)
    first = F.array_position(places, False).cast("int")
    return F.when(length <= 0, 0).when(first == 0, length).otherwise(first - 1)


def matching_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks ``(id, a, b, size)`` of lines that ``previous_text`` and ``content_text`` share in order.

    The longest common block comes first (of equal ones the earliest in the
    old, then in the new text); the same is done with what lies before it
    in both texts and with what lies behind it, and so on. In long texts,
    frequent lines start no block, but a block goes on over them. One level of
    this recursion is one step here, for all parts of all pages at once: equal
    lines are numbered along their diagonals, and the longest run of each part
    is an aggregate. Each step is written to the shared folder.
    """
    texts = pairs.select("id", F.posexplode_outer(lines_of(F.col("content_text"))).alias("b", "line"))
    olds = pairs.select("id", F.posexplode_outer(lines_of(F.col("previous_text"))).alias("a", "line"))
    new, old = texts.filter("b is not null"), olds.filter("a is not null")
    # a line is named by its first place in the new text, so that pages carry numbers and not texts from here on
    seen = new.groupBy("id", "line").agg(F.min("b").alias("name"), F.count("*").alias("n"))
    sizes = new.groupBy("id").agg(F.count("*").alias("lines"))
    popular = (F.col("lines") >= MANY_LINES) & (F.col("n") > F.floor(F.col("lines") / 100) + 1)
    names = seen.join(sizes, "id").select("id", "line", "name", popular.alias("popular"))
    b = new.join(names, ["id", "line"]).select("id", "b", "name", "popular")
    a = old.join(names, ["id", "line"], "left").select("id", "a", F.coalesce("name", -1 - F.col("a")).alias("name"), "popular")
    b, a = cut_lineage(b), cut_lineage(a)
    listed = lambda side, at: F.transform(F.sort_array(F.collect_list(F.struct(at, "name"))), lambda x: x["name"])
    many = F.max("popular").alias("many")
    arrays = cut_lineage(a.groupBy("id").agg(listed(a, "a").alias("old")).join(b.groupBy("id").agg(listed(b, "b").alias("new"), many), "id"))

    starts = a.filter("not popular").select("id", "a", "name").join(b.filter("not popular").select("id", "b", "name"), ["id", "name"])
    whole = arrays.select("id", F.lit(0).alias("alo"), F.size("old").alias("ahi"), F.lit(0).alias("blo"), F.size("new").alias("bhi"))
    equal = cut_lineage(starts.select("id", "a", "b").join(whole, "id"))
    parts = whole
    found: list[DataFrame] = []
    while not parts.isEmpty():
        diagonal = F.col("a") - F.col("b")
        along = Window.partitionBy(*_SEGMENT, diagonal).orderBy("a")
        runs = equal.withColumn("run", F.col("a") - F.row_number().over(along)).groupBy(*_SEGMENT, diagonal.alias("diagonal"), "run").agg(
            F.count("*").cast("int").alias("size"), F.min("a").alias("a"), F.min("b").alias("b"))
        longest = F.max(F.struct("size", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m")
        best = runs.groupBy(*_SEGMENT).agg(longest)
        # without a start, lines that are equal at the beginning of both parts still make a block
        at = parts.join(best, _SEGMENT, "left").join(arrays, "id").select(
            *_SEGMENT, "old", "new", F.coalesce(-F.col("m.a"), "alo").alias("a"), F.coalesce(-F.col("m.b"), "blo").alias("b"),
            F.coalesce("m.size", F.lit(0)).alias("size"))
        back = _equal_run(F.least(F.col("a") - F.col("alo"), F.col("b") - F.col("blo")),
                          lambda t: F.get(F.col("old"), F.col("a") - t) == F.get(F.col("new"), F.col("b") - t))
        ahead = _equal_run(F.least(F.col("ahi") - F.col("a"), F.col("bhi") - F.col("b")) - F.col("size"),
                           lambda t: F.get(F.col("old"), F.col("a") + F.col("size") + t - 1) == F.get(F.col("new"), F.col("b") + F.col("size") + t - 1))
        at = at.withColumns({"back": back, "ahead": ahead})
        blocks = cut_lineage(at.select(*_SEGMENT, (F.col("a") - F.col("back")).alias("from_a"), (F.col("b") - F.col("back")).alias("from_b"),
                                       (F.col("size") + F.col("back") + F.col("ahead")).alias("length")).filter("length > 0"))
        found.append(blocks.select("id", F.col("from_a").alias("a"), F.col("from_b").alias("b"), F.col("length").alias("size")))
        end_a, end_b = F.col("from_a") + F.col("length"), F.col("from_b") + F.col("length")
        before = ["alo", F.col("from_a").alias("ahi"), "blo", F.col("from_b").alias("bhi")]
        behind = [end_a.alias("alo"), "ahi", end_b.alias("blo"), "bhi"]
        rest = equal.join(blocks, _SEGMENT)
        equal = cut_lineage(
            rest.filter((F.col("a") < F.col("from_a")) & (F.col("b") < F.col("from_b"))).select("id", "a", "b", *before)
            .unionByName(rest.filter((F.col("a") >= end_a) & (F.col("b") >= end_b)).select("id", "a", "b", *behind)))
        frequent = blocks.join(arrays.filter("many").select("id"), "id", "left_semi")
        frequent = frequent.select("id", *before).unionByName(frequent.select("id", *behind)).filter("alo < ahi and blo < bhi")
        parts = cut_lineage(equal.select(*_SEGMENT).unionByName(frequent).distinct())
    if not found:
        return arrays.select("id", *[F.lit(0).alias(c) for c in ("a", "b", "size")]).filter("size > 0")
    return reduce(DataFrame.unionByName, found)


def added_lines_in_order(pairs: DataFrame) -> DataFrame:
    """Lines of ``content_text`` outside the blocks it shares in order with ``previous_text``, per ``id``.

    A line that only moved counts as added, unlike in the multiset difference
    (:func:`..watch.added_lines`). ``pairs`` has one row for each id. Null texts
    are empty; pages without added lines have no row.
    """
    blocks = matching_blocks(pairs)
    kept = blocks.select("id", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("size") - 1)).alias("pos"))
    now = pairs.select("id", F.posexplode_outer(lines_of(F.col("content_text"))).alias("pos", "line")).filter("pos is not null")
    new = now.join(kept, ["id", "pos"], "left_anti")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return new.groupBy("id").agg(strip(F.array_join(lines, "\n")).alias("added_text"))
