"""Tagging postings by many search rules: rules are a table, met by the rarest character group of their words."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Characters of a group; shorter words are a group of their own.
GROUP = 3


def _groups(text: Column, size: Column | int) -> Column:
    """The different groups of ``size`` neighbouring characters of a text."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size)))).otherwise(
        F.array().cast("array<string>"))


def containing(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(text, word)`` for every text that contains the word.

    ``texts`` has ``text`` and ``words`` has ``word``, each value once. A word is
    filed under the one of its character groups that the fewest texts have, so the
    join key is selective whatever the number of words, and a match is verified
    by looking for the word. An empty word is in every text. Nulls match nothing.
    """
    own = words.filter("word <> ''").withColumn("size", F.least(F.length("word"), F.lit(GROUP)))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most GROUP numbers
    of_texts = F.flatten(F.array(*[_groups(F.col("text"), s) for s in sizes or [GROUP]]))
    filed = cut_lineage(texts.filter("text is not null").select("text", F.explode_outer(of_texts).alias("group")).filter(F.col("group").isNotNull()))
    spread = filed.groupBy("group").agg(F.count("*").alias("n"))
    choices = own.select("word", F.explode(_groups(F.col("word"), F.col("size"))).alias("group")).join(spread, "group", "left")
    # a group that no text has decides as well: its word is in no text
    index = choices.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("group"))).alias("m")).select("word", "m.group")
    met = filed.join(index, "group").filter(F.col("text").contains(F.col("word"))).select("text", "word")
    if words.filter("word = ''").isEmpty():
        return met
    return met.unionByName(texts.filter("text is not null").select("text", F.lit("").alias("word")))


def _whole(place: Column, pattern: Column) -> Column:
    """Whether a place holds the pattern as a whole name: an edge of a word where the pattern begins or ends with a letter or digit."""
    edge = lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.lit(r"\b")).otherwise(F.lit(""))
    quoted = F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_like(place, F.concat(F.lit("(?iU)"), edge(F.left(pattern, F.lit(1))), quoted, edge(F.right(pattern, F.lit(1)))))


def _alike(wanted: DataFrame) -> DataFrame:
    """``(name, alike)``: rules that the same words include, exclude and place share one ``alike``."""
    words = lambda kind, value: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, value)))
    bound = F.max((F.col("kind") == "location") & ~F.coalesce("nationwide", F.lit(False)))
    return wanted.groupBy("name").agg(
        words("include", F.col("word")).alias("i"), words("exclude", F.col("word")).alias("e"),
        words("location", F.col("pattern")).alias("p"), F.coalesce(bound, F.lit(False)).alias("b")).select(
        "name", F.md5(F.to_json(F.struct("i", "e", "p", "b"))).alias("alike"))


def tag_postings(postings: DataFrame, patterns: DataFrame, key: str = "internal_id", columns: dict[str, Column] | None = None) -> DataFrame:
    """``(key, rules)``: the sorted names of all rules that match each posting.

    ``postings`` has the key, ``title`` and ``location``; ``patterns`` has
    ``name, nationwide, kind`` (include, exclude, location) and ``pattern``, one row
    for each (see ``sources.registry.rule_patterns``). A rule matches if the
    title contains an include word and no exclude word, and, unless the rule is
    nationwide or has no locations, the place holds one of its locations as a whole name. Titles and places
    are compared in lower case and once for each different one, and rules with the same
    words as one; the names are gathered once for each different set of these. ``columns`` are expressions on ``rules``,
    computed once for each different list and returned in place of it, so that long lists need not go to every posting. For a few
    rules ``functions.predicates.matching_rules`` needs no join.
    """
    rows = postings.select(key, F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("location", F.lit("")).alias("location"))
    rows = cut_lineage(rows)
    named = cut_lineage(patterns.select("name", "nationwide", "kind", "pattern", F.lower("pattern").alias("word")).filter(
        "word is not null and name is not null").distinct())
    alike = cut_lineage(_alike(named))
    # one rule stands for all that are alike
    standing = alike.groupBy("alike").agg(F.min("name").alias("name"))
    wanted = cut_lineage(named.join(standing.hint("merge"), "name").drop("name"))

    def met(texts: DataFrame, *kinds: str) -> DataFrame:
        chosen = wanted.filter(F.col("kind").isin(*kinds))
        return containing(texts.select("text").distinct(), chosen.select("word").distinct()).join(chosen, "word")

    titles = cut_lineage(met(rows.select(F.col("title").alias("text")), "include", "exclude").select(
        F.col("text").alias("title"), "alike", "kind").distinct())
    chosen = titles.filter("kind = 'include'").join(titles.filter("kind = 'exclude'").hint("merge"), ["title", "alike"], "left_anti").select("title", "alike")
    places = rows.select("location", F.lower("location").alias("text")).distinct()
    there = met(places, "location").join(places, "text").filter(_whole(F.col("location"), F.col("pattern"))).select("location", "alike").distinct()
    profiles = cut_lineage(rows.select("title", "location").distinct())
    # no broadcasts here: the files store repeated texts once, and sizes are guessed before an explode or before names are gathered
    hits = cut_lineage(profiles.join(chosen.hint("merge"), "title"))
    bound = wanted.filter("kind = 'location' and not coalesce(nationwide, false)").select("alike").distinct()
    local = hits.join(bound.hint("merge"), "alike", "left_semi").join(there.hint("merge"), ["location", "alike"], "left_semi").select("title", "location", "alike")
    matched = hits.join(bound.hint("merge"), "alike", "left_anti").select("title", "location", "alike").unionByName(local)
    tagged = profiles.join(matched.hint("merge"), ["title", "location"], "left").groupBy("title", "location").agg(F.sort_array(F.collect_set("alike")).alias("all"))
    tagged = cut_lineage(tagged.withColumn("list", F.md5(F.array_join("all", ","))))
    names = alike.groupBy("alike").agg(F.collect_list("name").alias("names"))
    parts = tagged.groupBy("list").agg(F.first("all").alias("all")).select("list", F.explode_outer("all").alias("alike"))
    lists = parts.join(names.hint("merge"), "alike", "left").groupBy("list").agg(F.sort_array(F.flatten(F.collect_list("names"))).alias("rules"))
    tags = tagged.select("title", "location", "list").join(
        cut_lineage(lists.select("list", *[c.alias(n) for n, c in (columns or {"rules": F.col("rules")}).items()])), "list").drop("list")
    # two plain shuffles, so that Spark can split a profile with very many postings
    return rows.join(cut_lineage(tags), ["title", "location"]).drop("title", "location")
