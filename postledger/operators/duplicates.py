"""Duplicate postings within and across sources.

Two postings of different sources are duplicates when their score (company,
title, place and links; see ``functions.similarity``) reaches a threshold. Lists
of all such pairs grow with the square of a group of copies, so the relation is
kept in factored form:

* a *role* is one distinct (company, title, place) in normalised form, a *job*
  one distinct (company, title), a *spot* one (title, place), a *name* one title;
* a *link* joins two nodes of one of these scopes, or one with itself, either for all of
  their postings or only for those that share one apply or source URL.

Which scopes and URLs can reach a threshold follows from the points of the
score; thresholds above 0.7 need no spots and names, as company equality is
necessary there. The duplicate pairs are exactly the postings of linked nodes that differ
in source, and the score of a pair is the best of its links. Copies with equal
values are never compared; similar titles are found by unchanged segments, or by
shared rare letters.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import (APPLY_URL_POINTS, COMPANY_POINTS, LOCATION_POINTS, SOURCE_URL_POINTS,
                                    TITLE_POINTS, score, string_similarity)
from ..functions.text import normalize_company, normalize_location, normalize_title
from ..session import cut_lineage
from .skew import salted_join

DEFAULT_THRESHOLD = 0.8
# Letters from rare to common in titles; only the speed depends on this order.
_RARE_FIRST = "zqjxkvbywgfpmuhdclsonitrae "


def exact_duplicates(postings: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        postings.groupBy("source_id", "source_job_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    )


def exact_duplicates_of(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New postings whose key already exists in the same source."""
    return new.join(existing.select("source_id", "source_job_id"), ["source_id", "source_job_id"], "left_semi")


def with_role(postings: DataFrame) -> DataFrame:
    """Narrow table: id, source, URLs and normalised role and job of each posting.

    It is written once, since every kind of link and group reads it.
    """
    base = postings.select(
        "internal_id", "source_id",
        normalize_company(F.col("company_name")).alias("company"),
        normalize_title(F.col("title")).alias("title"),
        normalize_location(F.col("location")).alias("place"),
        F.coalesce("apply_url", F.lit("")).alias("apply_url"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
    )
    return cut_lineage(base.withColumns({
        "role": _key("company", "title", "place"), "job": _key("company", "title"), "spot": _key("title", "place"), "name": _key("title"),
    }))


def _key(*columns: str) -> Column:
    """A hash of the columns in which each stands with its length (- for null), so that different values never read alike."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]))


def _ranked(grams: Column) -> Column:
    """Letters in one global order, rare ones first."""
    return F.array_sort(F.transform(grams, lambda g: F.struct(F.instr(F.lit(_RARE_FIRST), g).alias("rank"), g.alias("gram"))))


def _tokens(ranked: Column) -> Column:
    """Letters with their occurrence number, so that repeats are different tokens.
    ``ranked`` is a stored column, so the lambda does not compute it again."""
    return F.transform(ranked, lambda x, i: F.concat(x["gram"], (i + 1 - F.array_position(ranked, x)).cast("string")))


#: From this similarity on, titles are met by segments; below, segments would be shorter than three characters or so.
SEGMENTS_FROM = 0.7
_OWN = ("item", "title", "low", "s_min", "s_max")


def similar_titles(items: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of different titles within equal ``block`` columns whose similarity
    is at least ``low``. Lossless.

    ``items`` has ``item``, ``title``, the block columns, ``low`` (equal within a
    block) and the range of its sources ``s_min, s_max``; pairs that hold only
    one source are left out. Returns the block columns and ``a, b, similarity``
    with ``a < b``.

    Close titles are met by segments (:func:`segment_candidates`), others by rare
    letters (:func:`letter_candidates`); either way the join key has more than the block, so
    a block with very many titles spreads over many keys, and AQE splits what is
    still hot. Candidates are verified by their edit distance.
    """
    close = F.col("low") >= SEGMENTS_FROM
    met = segment_candidates(items.filter(close), block).unionByName(letter_candidates(items.filter(~close), block))
    longest = F.greatest(F.length("title_a"), F.length("title_b"))
    allowed = F.floor(longest * (1 - F.col("low")) + 1e-9).cast("int")
    # with a limit only the cells near the diagonal are computed; beyond it the result is -1
    near = met.withColumn("allowed", allowed).filter("levenshtein(title_a, title_b, allowed) >= 0")
    # titles may meet at several segments
    return near.select(*block, F.col("item_a").alias("a"), F.col("item_b").alias("b"),
                       string_similarity(F.col("title_a"), F.col("title_b")).alias("similarity")).distinct()


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Spark guesses sizes from files, whose repeated
    texts are stored once, and counts no rows that an explode adds; so a large table may pass for a small
    one and be collected in the driver. AQE still splits skewed keys."""
    return df.hint("merge")


def _several_sources() -> Column:
    return F.least("s_min_a", "s_min_b") != F.greatest("s_max_a", "s_max_b")


def segment_candidates(items: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of titles of which one holds a segment of the other near its place.

    If the shorter of two titles within edit distance d is cut into d + 1 even
    segments, one of them stands unchanged in the longer one, shifted by no more than the
    edits before and behind it allow (Li et al., "Pass-Join", 2011). So a title
    is filed under its segments for every distance that a longer partner may
    have, and looks under its own pieces for each length of a shorter partner.
    The join key is a hash of (block, length, distance, segment number, text), as one number sorts
    faster than nine columns; the block is compared after it, and titles that only share the hash
    are one more pair to verify.
    """
    size = F.length("title")
    distance = lambda n: F.floor(n * (1 - F.col("low")) + 1e-9).cast("int")

    def segment(n: Column, d: Column, i: Column) -> tuple[Column, Column]:
        """Start and length of segment ``i`` of ``d + 1`` even ones of ``n`` characters, longer ones last."""
        base, longer = F.floor(n / (d + 1)).cast("int"), n % (d + 1)
        short = d + 1 - longer
        return i * base + F.greatest(i - short, F.lit(0)), base + F.when(i >= short, 1).otherwise(0)

    def filed(d: Column) -> Column:
        def one(i: Column) -> Column:
            start, length = segment(F.col("size"), d, i)
            return F.struct(d.alias("d"), i.alias("i"), F.substring(F.col("title"), start + 1, length).alias("text"))
        return F.transform(F.sequence(F.lit(0), d), one)

    def looked_up(n: Column) -> Column:
        d, shift = F.col("d"), F.col("size") - n

        def one(i: Column) -> Column:
            start, length = segment(n, d, i)
            first = F.greatest(start - i, start + shift - (d - i), F.lit(0))
            last = F.least(start + i, start + shift + (d - i), F.col("size") - length)
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(n.alias("n"), i.alias("i"), F.substring(F.col("title"), at + 1, length).alias("text")))
        return F.flatten(F.transform(F.sequence(F.lit(0), d), one))

    # nulls meet nothing, as in a join on the block
    titles = items.filter(size > 0).na.drop(subset=block).withColumn("size", size).withColumn("d", distance(F.col("size")))
    partners = F.sequence(F.col("size"), F.floor(F.col("size") / F.col("low") + 1e-9).cast("int"))
    distances = F.array_distinct(F.transform(partners, distance))
    at = lambda n, d: F.xxhash64("_block", n, d, "_piece.i", "_piece.text").alias("_at")
    named = titles.withColumn("_block", F.xxhash64(*block))
    index = named.select(*block, "_block", *_OWN, "size", F.explode(F.flatten(F.transform(distances, filed))).alias("_piece")).select(
        *block, at(F.col("size"), F.col("_piece.d")), *[F.col(c).alias(f"{c}_a") for c in _OWN])
    lengths = F.sequence(F.greatest(F.col("size") - F.col("d"), F.lit(1)), F.col("size"))
    pieces = F.array_distinct(F.flatten(F.transform(lengths, looked_up)))
    probe = named.select(*block, "_block", *_OWN, "d", F.explode(pieces).alias("_piece")).select(
        *[F.col(c).alias(f"{c}_b") for c in (*block, *_OWN)], at(F.col("_piece.n"), F.col("d")))
    la, lb = F.length("title_a"), F.length("title_b")
    met = index.join(_shuffled(probe), "_at").filter(
        _several_sources() & (F.col("title_a") != F.col("title_b")) & ((la < lb) | ((la == lb) & (F.col("item_a") < F.col("item_b")))))
    # counted, as single equalities would become columns to sort by
    equal = sum(((F.col(c) == F.col(f"{c}_b")).cast("int") for c in block), F.lit(0))
    met = met.filter(equal == len(block))
    swap = F.col("item_a") > F.col("item_b")
    pick = lambda c, one, other: F.when(swap, F.col(f"{c}_{other}")).otherwise(F.col(f"{c}_{one}")).alias(f"{c}_{one}")
    return met.select(*block, F.col("low_a").alias("low"), *[pick(c, one, other) for c in ("item", "title") for one, other in ("ab", "ba")])


def letter_candidates(items: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of titles that share one of their rarest letters.

    Titles within an edit distance d share all but d of their letters (with
    repeats), so two similar titles must share one of the rarest letters of each
    (prefix filter). A pair is made only at its first shared letter, so no
    pair is made twice.
    """
    length, low = F.length("title"), F.col("low")
    letters = F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(F.col("title"), i, F.lit(1)))
    # smallest number of shared letters over all lengths a partner can have
    shared = F.ceil(length * low - 1e-9)
    prefix_size = F.size("tokens") - F.greatest(shared, F.lit(1)) + 1
    keyed = (
        items.filter(length > 0).withColumn("ranked", _ranked(letters))
        .select(*block, *_OWN, _tokens(F.col("ranked")).alias("tokens"))
        .withColumn("prefix", F.slice("tokens", F.lit(1), F.greatest(prefix_size, F.lit(0)).cast("int")))
        # the outer form keeps the optimizer from computing the letters again in a
        # filter below; a title without any gets a null token, which joins nothing
        .select(*block, *_OWN, "prefix", F.explode_outer("prefix").alias("token"))
    )

    def side(name: str) -> DataFrame:
        return keyed.select(*block, "token", *[F.col(c).alias(f"{c}_{name}") for c in (*_OWN, "prefix")])

    la, lb = F.length("title_a"), F.length("title_b")
    # coalesce keeps the optimizer from inferring a not-null filter on the prefix,
    # which it would push down as a second computation of all letters
    prefix_of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    first_shared = F.coalesce(F.get(F.array_intersect(prefix_of("prefix_a"), prefix_of("prefix_b")), 0), F.lit(""))
    met = side("a").join(_shuffled(side("b")), [*block, "token"]).filter(
        (F.col("item_a") < F.col("item_b")) & _several_sources() & (F.col("title_a") != F.col("title_b"))
        & (F.least(la, lb) >= F.greatest(la, lb) * F.col("low_a") - 1e-9)
        & (first_shared == F.col("token"))
    )
    return met.select(*block, F.col("low_a").alias("low"), "item_a", "title_a", "item_b", "title_b")


#: Nodes of each scope share these columns; the title may differ between linked nodes.
_SCOPES = {"role": ("company", "place"), "job": ("company",), "spot": ("place",), "name": ()}
_PART_POINTS = {"company": COMPANY_POINTS, "place": LOCATION_POINTS}
_VIA_POINTS = {"any": 0, "apply_url": APPLY_URL_POINTS, "source_url": SOURCE_URL_POINTS}
_UNIT = ["scope", "via", "node", "url"]


def _needed_titles(threshold: float) -> dict[tuple[str, str], float]:
    """Kinds of link (scope, URL column or "any") that can reach the threshold, with the title similarity they need."""
    needed = {}
    for scope, shared in _SCOPES.items():
        for via, points in _VIA_POINTS.items():
            rest = threshold * 100 - points - sum(_PART_POINTS[c] for c in shared)
            needed[scope, via] = round(rest / TITLE_POINTS, 9)
    return {kind: max(x, 0.0) for kind, x in needed.items() if x <= 1}


def _kinds_of(links: DataFrame) -> list[tuple[str, str]]:
    """The kinds that occur, of which there are a dozen at most."""
    return sorted(tuple(r) for r in links.select("scope", "via").distinct().collect()) or [("role", "any")]


def _per_kind(rows: DataFrame, kinds: list[tuple[str, str]], *cols: str) -> DataFrame:
    """``cols`` of each row once per kind of link, with the unit it belongs to: its
    key in the scope as ``node``, and the shared ``url`` (empty if any will do)."""
    units = F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(via).alias("via"), F.col(scope).alias("node"),
                 (F.lit("") if via == "any" else F.col(via)).alias("url"))
        for scope, via in kinds
    ])
    return rows.select(*cols, F.explode(units).alias("k")).select(*cols, "k.*")


def _by_kind(values: dict[tuple[str, str], float]) -> Column:
    """The value that belongs to a row's kind."""
    chain = F.lit(None).cast("double")
    for (scope, via), value in values.items():
        chain = F.when((F.col("scope") == scope) & (F.col("via") == via), F.lit(float(value))).otherwise(chain)
    return chain


def _shares(part: str) -> Column:
    return F.col("scope").isin(*[scope for scope, shared in _SCOPES.items() if part in shared])


def _titles_of_block(items: DataFrame, block: list[str]) -> DataFrame:
    """All pairs of different titles within a block: those links need no similarity, so each pair is one. An equi join on the block."""
    own = ("item", "title", "s_min", "s_max")
    a, b = (items.select(*block, *[F.col(c).alias(f"{c}_{name}") for c in own]) for name in "ab")
    return a.join(_shuffled(b), block).filter((F.col("item_a") < F.col("item_b")) & (F.least("s_min_a", "s_min_b") != F.greatest("s_max_a", "s_max_b"))).select(
        *block, F.col("item_a").alias("a"), F.col("item_b").alias("b"), string_similarity(F.col("title_a"), F.col("title_b")).alias("similarity"))


def _reversed_too(links: DataFrame) -> DataFrame:
    back = links.filter("node_a <> node_b").select(
        "scope", F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "via", "url", "score")
    return links.unionByName(back)


def duplicate_links(roles: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Links ``(scope, node_a, node_b, via, url, score)`` with ``node_a <= node_b``.

    ``via`` is ``any`` (all postings of both nodes), ``apply_url`` or
    ``source_url`` (those that share ``url``). Up to 0.4 equal titles alone
    would make duplicates, wherever they are; such thresholds are refused. All
    kinds go through one grouping and one join. Where company, place and URL
    reach the threshold without the title, all titles of the block are linked.
    """
    if not TITLE_POINTS / 100 < threshold <= 1:
        raise ValueError("threshold must be above 0.4 and at most 1")
    needed = _needed_titles(threshold)
    block = ["scope", "via", "company", "area", "url"]
    # two units hold different sources exactly when their joint range is not one value
    units = cut_lineage(
        _per_kind(roles, list(needed), "source_id", "company", "title", "place")
        .withColumns({"area": F.when(_shares("place"), F.col("place")).otherwise(F.lit("")),
                      "company": F.when(_shares("company"), F.col("company")).otherwise(F.lit("")), "low": _by_kind(needed)})
        .groupBy(*block, "node", "title", "low")
        .agg(F.min("source_id").alias("s_min"), F.max("source_id").alias("s_max"))
    )
    alone = units.filter("s_min <> s_max").select(
        *block, F.col("node").alias("node_a"), F.col("node").alias("node_b"), F.lit(1.0).alias("similarity"))
    items = units.withColumnRenamed("node", "item")
    near = similar_titles(items.filter("low > 0 and low < 1"), block)
    if not all(needed.values()):
        near = near.unionByName(_titles_of_block(items.filter("low = 0"), block))
    near = near.select(*block, F.col("a").alias("node_a"), F.col("b").alias("node_b"), "similarity")
    points = score(_shares("company"), F.col("similarity"), _shares("place"), F.col("via") == "apply_url", F.col("via") == "source_url")
    return cut_lineage(alone.unionByName(near).select("scope", "node_a", "node_b", "via", "url", points.alias("score")))


def _two_best(rows: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """Per key the best offer and the best one of any other source."""
    per_source = rows.groupBy(*keys, "source_id").agg(F.min(best).alias("offer"))
    rank = Window.partitionBy(*keys).orderBy("offer")
    top = per_source.withColumn("n", F.row_number().over(rank)).filter("n <= 2")
    return top.groupBy(*keys).agg(
        F.min_by("offer", "n").alias("first"), F.min_by("source_id", "n").alias("first_source"),
        F.max_by("offer", "n").alias("second"), F.max_by("source_id", "n").alias("second_source"),
        F.count("*").alias("offers"))


_PROFILE = [*_SCOPES, "apply_url", "source_url"]


def _smallest_ids(roles: DataFrame) -> DataFrame:
    """One row per profile and source, under its smallest id: copies beyond it offer and get nothing else."""
    return roles.groupBy(*_PROFILE, "source_id").agg(F.min("internal_id").alias("internal_id"))


def best_duplicates(roles: DataFrame, links: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Best-scoring duplicate of each posting: ``internal_id, duplicate_id, score``.

    The duplicate comes from ``among`` (by default from ``roles`` itself); links
    must cover both. Ties go to the smallest id. Postings of one source that no
    link can tell apart have the same best duplicate, so only the smallest id of
    each such set takes part, and postings are joined once at the end. A node
    offers at most two postings, the smallest ids of two sources, so work is per
    node and link, never per pair of postings.
    """
    kinds = _kinds_of(links)
    own = cut_lineage(_smallest_ids(roles))
    rows = _per_kind(own, kinds, "internal_id", "source_id")
    pool = rows if among is None else _per_kind(_smallest_ids(among), kinds, "internal_id", "source_id")
    smallest = _two_best(pool, _UNIT, F.struct(F.col("internal_id").alias("id")))
    offered = smallest.select(
        "scope", "via", F.col("node").alias("node_b"), "url",
        F.explode(F.array_compact(F.array(
            F.struct(F.col("first.id").alias("id"), F.col("first_source").alias("source_id")),
            F.when(F.col("offers") > 1, F.struct(F.col("second.id").alias("id"), F.col("second_source").alias("source_id"))),
        ))).alias("o"))
    offers = _reversed_too(links).join(_shuffled(offered), ["scope", "via", "node_b", "url"]).select(
        "scope", "via", F.col("node_a").alias("node"), "url", "score", "o.id", "o.source_id")
    best = _two_best(offers, _UNIT, F.struct((-F.col("score")).alias("s"), F.col("id").alias("id")))
    other = F.when(F.col("first_source") != F.col("source_id"), F.col("first")).when(F.col("offers") > 1, F.col("second"))
    picks = rows.join(_shuffled(best), _UNIT).select("internal_id", other.alias("best")).filter("best is not null")
    chosen = picks.groupBy("internal_id").agg(F.min("best").alias("best")).join(_shuffled(own), "internal_id").drop("internal_id")
    # AQE splits a profile with very many postings: both sides are plain shuffles
    return roles.join(_shuffled(cut_lineage(chosen)), [*_PROFILE, "source_id"]).select(
        "internal_id", F.col("best.id").alias("duplicate_id"), (-F.col("best.s")).alias("score"))


def duplicates_of(new: DataFrame, existing: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """All duplicates of a few ``new`` postings among ``existing``, ranked by score.

    This is the explicit pair list, so its size is the number of pairs asked for.
    Whole collections use links, ``best_duplicates`` and ``duplicate_groups``.
    """
    n, e = with_role(new), with_role(existing)
    links = _reversed_too(duplicate_links(n.unionByName(e), threshold))
    kinds = _kinds_of(links)
    left = _per_kind(n, kinds, "internal_id", "source_id").select(
        "scope", "via", F.col("node").alias("node_a"), "url", "internal_id", F.col("source_id").alias("s"))
    right = _per_kind(e, kinds, "internal_id", "source_id").select(
        "scope", "via", F.col("node").alias("node_b"), "url", F.col("internal_id").alias("duplicate_id"), F.col("source_id").alias("t"))
    on_a, on_b = ["scope", "via", "node_a", "url"], ["scope", "via", "node_b", "url"]
    scored = left.join(_shuffled(links), on_a).join(_shuffled(right), on_b).filter("s <> t").groupBy("internal_id", "duplicate_id").agg(
        F.max("score").alias("score"))
    rank = Window.partitionBy("internal_id").orderBy(F.col("score").desc(), "duplicate_id")
    return scored.withColumn("rank", F.row_number().over(rank))


def _profiles(roles: DataFrame) -> DataFrame:
    """Postings that no link can tell apart, under the smallest of their ids."""
    return roles.groupBy(*_PROFILE).agg(F.min("internal_id").alias("profile"))


def _edges(profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Edges that connect exactly the linked postings: each linked node to its
    profiles, and linked nodes to each other. Profiles sort before nodes, so the
    smallest label of a component is its smallest posting id."""
    name = lambda node: F.concat_ws(":", F.lit("z"), "scope", "via", node, "url")
    across = links.filter("node_a <> node_b").select(name("node_a").alias("u"), name("node_b").alias("v"))
    live = links.select("scope", "via", F.explode(F.array("node_a", "node_b")).alias("node"), "url").distinct()
    members = _per_kind(profiles, _kinds_of(links), "profile").join(_shuffled(live), _UNIT, "left_semi")
    return across.unionByName(members.select(name("node").alias("u"), F.concat(F.lit("p:"), "profile").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph with columns ``u, v``.

    Alternates the large-star and small-star steps of Kiveris et al.
    ("Connected Components in MapReduce and Beyond", 2014): every node is
    re-attached to the smallest neighbour it knows, which needs few rounds even
    on long chains. Each round is written to the shared folder; rounds go on until
    one changes nothing.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # one row per node on the right; AQE splits a node with very many neighbours
        moved = both.join(low, "u")
        if large:
            kept = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            kept = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v")))
        return kept.filter("u <> v").distinct()

    current = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    mark = None
    while before is None or mark != before:
        before = mark
        current = cut_lineage(star(star(current, True), False))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def duplicate_groups(roles: DataFrame, links: DataFrame) -> DataFrame:
    """Group and confidence of every posting that has a duplicate.

    The group is the smallest posting id among all connected postings.
    """
    profiles = cut_lineage(_profiles(roles))
    parts = connected_components(_edges(profiles, links)).filter(F.col("node").startswith("p:")).select(
        F.expr("substring(node, 3)").alias("profile"), F.expr("substring(component, 3)").alias("possible_duplicate_group"))
    keyed = profiles.join(_shuffled(parts), "profile").drop("profile")
    groups = roles.join(_shuffled(keyed), _PROFILE).select("internal_id", "possible_duplicate_group")
    best = best_duplicates(roles, links).select("internal_id", F.col("score").alias("duplicate_confidence"))
    return groups.join(_shuffled(best), "internal_id")


def update_groups(groups: DataFrame, roles: DataFrame, changed: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``duplicate_groups`` of ``roles`` from those of the run before, solved again only where something moved.

    ``groups`` is the last result, ``roles`` the postings of now and ``changed``
    those that arrived, went or read differently, as they were and as they are
    (all as of ``with_role``). Above a threshold of 0.7 linked postings share their company, so a component
    never leaves one: companies that no changed posting has keep their groups
    as they are, all others are linked and solved anew, which also splits what a
    lost link held together. Equal to a full run.
    """
    if not threshold > 0.7:
        raise ValueError("components stay within a company above 0.7 only")
    # null companies are linked to none
    moved = changed.select("company").filter("company is not null").distinct()
    part = cut_lineage(salted_join(roles, moved, ["company"], "left_semi", F.col("internal_id")))
    fresh = duplicate_groups(part, duplicate_links(part, threshold))
    still = salted_join(roles, moved, ["company"], "left_anti", F.col("internal_id")).select("internal_id")
    return groups.join(still, "internal_id", "left_semi").unionByName(fresh.select(*groups.columns))
