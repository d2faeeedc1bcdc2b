"""Watched pages: what text was added since the last check."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import extract_text
from ..functions.predicates import MIN_MEANINGFUL_CHARS, meaningful, soft_404
from ..functions.records import keywords_found
from ..functions.text import strip

# --- fixed values -------------------------------------------------------------------
MAX_ERROR_CHARS = 500
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_SOFT_404_MESSAGE = "page returned 200 but looks like a 404: "
# ------------------------------------------------------------------------------------


def page_texts(pages: DataFrame) -> DataFrame:
    """Visible text, its hash and the check's error. ``pages`` has ``id, name,
    url, final_url, http_status, error, html, checked_at``. Map-only."""
    fetched = F.col("error").isNull() & F.col("http_status").between(200, 299)
    text = pages.withColumn("content_text", F.when(fetched, extract_text(F.col("html")))).drop("html")
    failed = F.coalesce(F.col("error"), F.when(~F.coalesce(fetched, F.lit(False)), F.concat(
        F.lit("HTTP error: "), F.coalesce(F.col("http_status").cast("string"), F.lit("no response")))))
    missing = F.when(soft_404(F.col("content_text")),
                     F.concat(F.lit(_SOFT_404_MESSAGE), F.coalesce("final_url", "url")))
    return text.withColumn("check_error", F.coalesce(failed, missing)).select(
        "id", "name", "url", "checked_at", "check_error",
        F.when(F.col("check_error").isNull(), F.col("content_text")).alias("content_text"),
        F.when(F.col("check_error").isNull(), F.sha2("content_text", 256)).alias("content_hash"),
    )


def added_lines(pairs: DataFrame) -> DataFrame:
    """Lines of ``content_text`` beyond those in ``previous_text``, per ``id``.

    Counts occurrences of each line (multiset difference) and keeps page order.
    Work is keyed by (page, line), so one long page is many small keys.
    """
    now = pairs.select("id", F.posexplode_outer(F.split("content_text", LINE_END)).alias("pos", "line"))
    old = pairs.select("id", F.explode_outer(F.split(F.coalesce("previous_text", F.lit("")), LINE_END)).alias("line"))
    had = old.groupBy("id", "line").agg(F.count("*").alias("had"))
    nth = Window.partitionBy("id", "line").orderBy("pos")
    new = (
        now.withColumn("n", F.row_number().over(nth)).join(had, ["id", "line"], "left")
        .filter(F.col("n") > F.coalesce("had", F.lit(0)))
    )
    # rebuilding the text of one page is bounded by the page itself
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return new.groupBy("id").agg(strip(F.array_join(lines, "\n")).alias("added_text"))


def watch_diff(texts: DataFrame, state: DataFrame, min_chars: int = MIN_MEANINGFUL_CHARS) -> DataFrame:
    """Outcome of each check against the stored page.

    Added text is what :func:`added_lines` finds. Little added text counts as
    unchanged, but the new text is stored so that it is not reported again.
    """
    old = state.select("id", *[F.col(c).alias(f"previous_{c}") for c in (
        "content_hash", "content_text", "first_seen_at", "last_changed_at", "last_added_text")],
        F.lit(True).alias("known"))
    both = texts.join(old, "id", "left").withColumnRenamed("previous_content_text", "previous_text")
    known = F.coalesce(F.col("known"), F.lit(False))
    differs = F.coalesce(F.col("check_error").isNull() & known
                         & ~F.col("content_hash").eqNullSafe(F.col("previous_content_hash")), F.lit(False))
    both = both.join(added_lines(both.filter(differs).select("id", "content_text", "previous_text")), "id", "left")
    added = F.coalesce("added_text", F.lit(""))
    status = (
        F.when(F.col("check_error").isNotNull(), F.lit("error"))
        .when(~known, F.lit("new"))
        .when(differs & meaningful(added, min_chars), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return both.select(
        "id", "name", "url", "checked_at", "content_text", "content_hash", status.alias("status"), "check_error",
        F.when(status == "changed", added).otherwise(F.lit("")).alias("added_text"),
        differs.alias("differs"), "previous_first_seen_at", "previous_last_changed_at",
    )


def watch_results(diff: DataFrame, watches: DataFrame) -> DataFrame:
    """Report rows: status, keywords in the added text and the date of change."""
    changed_at = F.when(F.col("status").isin("new", "changed"), F.col("checked_at")).otherwise(
        F.col("previous_last_changed_at"))
    return diff.join(watches.select("id", "keywords"), "id", "left").select(
        "id", "name", "url", "status", "added_text",
        keywords_found(F.col("added_text"), F.col("keywords")).alias("keywords_found"),
        F.when(F.col("status") != "error", changed_at).alias("last_changed_at"),
        F.coalesce("check_error", F.lit("")).alias("error"),
    )


def next_watch_state(diff: DataFrame, state: DataFrame) -> DataFrame:
    """Stored pages after the checks; each outcome updates its own columns."""
    new = diff.select("id", *[F.col(c).alias(f"n_{c}") for c in (
        "name", "url", "checked_at", "content_text", "content_hash", "status", "check_error", "added_text", "differs")])
    both = new.join(state, "id", "full")
    checked = F.col("n_status").isNotNull()
    stored = F.coalesce((F.col("n_status") == "new") | F.col("n_differs"), F.lit(False))
    moved = F.coalesce(F.col("n_status").isin("new", "changed"), F.lit(False))
    insert = checked & F.col("last_status").isNull()

    def pick(test: Column, new_value: Column, name: str) -> Column:
        return F.when(test, new_value).otherwise(F.col(name)).alias(name)

    return both.select(
        "id",
        pick(stored | insert, F.col("n_url"), "url"),
        pick(stored | insert, F.col("n_name"), "name"),
        pick(stored, F.col("n_content_hash"), "content_hash"),
        pick(stored, F.col("n_content_text"), "content_text"),
        pick(insert & (F.col("n_status") != "error"), F.col("n_checked_at"), "first_seen_at"),
        pick(checked, F.col("n_checked_at"), "last_checked_at"),
        pick(moved, F.col("n_checked_at"), "last_changed_at"),
        pick(checked, F.col("n_status"), "last_status"),
        F.when(F.col("n_status") == "error", F.substring("n_check_error", 1, MAX_ERROR_CHARS))
        .when(stored, F.lit("")).otherwise(F.col("last_error")).alias("last_error"),
        pick(stored, F.col("n_added_text"), "last_added_text"),
    )


def watch_feed_state(watches: DataFrame, state: DataFrame) -> DataFrame:
    """Last stored outcome of each watch, in the form the feed renders; watches
    never checked are left out."""
    status = F.when(F.col("last_status").isin("changed", "error"), F.col("last_status")).otherwise(F.lit("unchanged"))
    kept = state.select("id", "last_status", "last_changed_at", "last_error", "last_added_text")
    return watches.select("id", "name", "url", "keywords").join(kept, "id").select(
        "id", "name", "url", status.alias("status"),
        F.coalesce("last_added_text", F.lit("")).alias("added_text"),
        keywords_found(F.col("last_added_text"), F.col("keywords")).alias("keywords_found"),
        "last_changed_at", F.coalesce("last_error", F.lit("")).alias("error"),
    )
