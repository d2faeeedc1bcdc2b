"""Comparison of a run with the previous snapshot, and the snapshot after it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import internal_id
from ..schemas import POSTING, POSTING_KEY
from .skew import salted_join

KEY = list(POSTING_KEY)
STATE_EXTRA = ("internal_id", "first_seen_at", "last_seen_at", "last_changed_at", "active", "state_version", "last_status")


def last_in_run(postings: DataFrame, order: Column) -> DataFrame:
    """One row per key; the last one of the run wins.

    Spark trims each task's rows to one per key before the shuffle, so a key
    repeated many times does not pile up in one task.
    """
    newest = Window.partitionBy(*KEY).orderBy(order.desc())
    return postings.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def detect_status(current: DataFrame, state: DataFrame) -> DataFrame:
    """``current`` with its status against the snapshot. An inactive posting is
    reopened whatever its content."""
    known = state.select(*KEY, F.col("content_hash").alias("_hash"), F.col("active").alias("_active"))
    return current.join(known, KEY, "left").withColumn("status", _status()).drop("_hash", "_active")


def _status() -> Column:
    return (
        F.when(F.col("_active").isNull(), F.lit("new"))
        .when(~F.col("_active"), F.lit("reopened"))
        .when(F.col("content_hash") == F.col("_hash"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )


def seen_sources(current: DataFrame) -> DataFrame:
    """Sources with at least one posting in the run."""
    return current.select("source_id").distinct()


def detect_expired(current: DataFrame, state: DataFrame, expirable: DataFrame | None = None) -> DataFrame:
    """Keys that were active and are gone.

    Only sources in ``expirable`` expire anything. By default these are the
    sources seen in the run, so a failed source keeps its postings. Only keys
    travel here; a source with very many postings is spread over salts.
    """
    gone = state.filter("active").select(*KEY).join(current.select(*KEY), KEY, "left_anti")
    sources = seen_sources(current) if expirable is None else expirable.select("source_id").distinct()
    return salted_join(gone, sources, ["source_id"], "left_semi", F.col("source_job_id"))


def complete_sources(current: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Seen sources whose collection is known to be whole."""
    return seen_sources(current).join(incomplete.select("source_id").distinct(), "source_id", "left_anti")


def snapshot_diff(current: DataFrame, state: DataFrame, expirable: DataFrame | None = None) -> DataFrame:
    """Every posting of the run and of the snapshot, with its transition.

    ``status`` is null for postings that stay inactive or whose source may not
    expire anything (see ``detect_expired``). Each side is read and shuffled
    once, on the key; besides that only the short list of sources is joined,
    before the full join, which Spark broadcasts by its measured size.
    """
    sources = seen_sources(current) if expirable is None else expirable.select("source_id").distinct()
    marked = salted_join(state, sources.withColumn("_can_expire", F.lit(True)), ["source_id"], "left", F.col("source_job_id"))
    old = marked.select(
        *KEY,
        *[F.col(c).alias(f"_old_{c}") for c in POSTING if c not in KEY],
        *[F.col(c).alias(f"_old_{c}") for c in STATE_EXTRA if c in state.columns and c != "internal_id"],
        (F.col("active") & F.coalesce("_can_expire", F.lit(False))).alias("_gone"),
    )
    now = current.select(*POSTING, F.lit(True).alias("_seen"))
    both = now.join(old, KEY, "full")
    seen = F.coalesce(F.col("_seen"), F.lit(False))
    status = F.when(
        seen,
        F.when(F.col("_old_active").isNull(), F.lit("new"))
        .when(~F.col("_old_active"), F.lit("reopened"))
        .when(F.col("content_hash") == F.col("_old_content_hash"), F.lit("unchanged"))
        .otherwise(F.lit("changed")),
    ).when(F.col("_gone"), F.lit("expired"))
    values = [
        F.col(c) if c in KEY else F.when(seen, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in POSTING
    ]
    last = F.col("_old_last_status") if "last_status" in state.columns else F.lit(None).cast("string")
    return both.select(
        internal_id(F.col("source_id"), F.col("source_job_id")).alias("internal_id"),
        *values,
        status.alias("status"),
        seen.alias("seen"),
        F.col("_old_content_hash").alias("previous_hash"),
        F.col("_old_active").alias("was_active"),
        F.col("_old_first_seen_at").alias("previous_first_seen_at"),
        F.col("_old_last_seen_at").alias("previous_last_seen_at"),
        F.col("_old_last_changed_at").alias("previous_last_changed_at"),
        F.col("_old_state_version").alias("previous_version"),
        last.alias("previous_status"),
    )


def next_state(diff: DataFrame, run_at: Column, version: int) -> DataFrame:
    """Snapshot after the run: insert, update, expire or carry over."""
    at = run_at.cast("timestamp_ntz")
    expired = F.coalesce(F.col("status") == "expired", F.lit(False))
    touched = F.col("seen") | expired
    altered = F.col("seen") & ~F.coalesce(F.col("content_hash") == F.col("previous_hash"), F.lit(False))
    return diff.select(
        "internal_id",
        *POSTING,
        F.coalesce(F.col("previous_first_seen_at"), at).alias("first_seen_at"),
        F.when(touched, at).otherwise(F.col("previous_last_seen_at")).alias("last_seen_at"),
        F.when(altered, at).otherwise(F.col("previous_last_changed_at")).alias("last_changed_at"),
        F.when(F.col("seen"), F.lit(True)).when(expired, F.lit(False)).otherwise(F.col("was_active")).alias("active"),
        F.when(touched, F.lit(version)).otherwise(F.col("previous_version")).cast("int").alias("state_version"),
        F.coalesce("status", "previous_status").alias("last_status"),
    )


def inventory(state: DataFrame, version: int) -> DataFrame:
    """The whole stored snapshot for publishing: ``status`` is the latest one of
    each posting, ``touched`` tells whether this run gave it."""
    return state.withColumnRenamed("last_status", "status").withColumn("touched", F.col("state_version") == version)


def transitions(state: DataFrame, version: int) -> DataFrame:
    """Postings that the run of a stored snapshot touched, with their status: a
    narrow scan of the snapshot, no join."""
    return state.filter(F.col("state_version") == version).select(
        "internal_id", *KEY, "content_hash", F.col("last_status").alias("status"))


def observations(diff: DataFrame, run_id: Column, observed_at: Column) -> DataFrame:
    """Log rows of the run, expired postings included. The id is derived, so a
    repeated run writes the same rows."""
    return diff.filter(F.col("status").isNotNull()).select(
        run_id.alias("run_id"),
        F.sha2(F.concat_ws("|", run_id, F.col("internal_id")), 256).alias("observation_id"),
        observed_at.cast("timestamp_ntz").alias("observed_at"),
        "internal_id", *KEY, "content_hash", "status",
    )


def latest_observation(log: DataFrame) -> DataFrame:
    """Newest log row of each posting; combined within tasks before the shuffle."""
    order = F.struct("observed_at", "run_id", "observation_id")
    newest = F.max_by(F.struct("status", "content_hash", "run_id", "observed_at"), order)
    return log.groupBy("internal_id").agg(newest.alias("o")).select("internal_id", "o.*")


def recent_postings(state: DataFrame, log: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Active postings with the status of their newest observation."""
    newest = latest_observation(log).select("internal_id", "status")
    if statuses:
        newest = newest.filter(F.col("status").isin(*statuses))
    return state.filter("active").join(newest, "internal_id")


def merge_companies(stored: DataFrame, configured: DataFrame, at: Column) -> DataFrame:
    """Upsert by id: name and flag follow the configuration."""
    when = at.cast("timestamp_ntz")
    old = stored.select("id", *[F.col(c).alias(f"_{c}") for c in ("name", "enabled", "priority", "created_at", "updated_at")])
    new = configured.select("id", "name", "enabled", "priority", F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return new.join(old, "id", "full").select(
        "id",
        F.when(hit, F.col("name")).otherwise(F.col("_name")).alias("name"),
        F.when(hit, F.col("enabled")).otherwise(F.col("_enabled")).alias("enabled"),
        F.coalesce(F.col("_priority"), F.col("priority")).alias("priority"),
        F.coalesce(F.col("_created_at"), when).alias("created_at"),
        F.when(hit, when).otherwise(F.col("_updated_at")).alias("updated_at"),
    )


def merge_sources(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Upsert by ``source_id``: type and key follow the configuration, the
    health columns of known sources are kept."""
    health = [c for c in stored.columns if c not in ("source_id", "company_id", "source_type", "source_key", "enabled")]
    old = stored.select("source_id", *[F.col(c).alias(f"_{c}") for c in ("company_id", "source_type", "source_key", "enabled")], *health)
    new = configured.select("source_id", "company_id", "source_type", "source_key", F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    pick = lambda c: F.when(hit, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return new.join(old, "source_id", "full").select(
        "source_id", F.coalesce(F.col("_company_id"), F.col("company_id")).alias("company_id"),
        pick("source_type"), pick("source_key"),
        F.coalesce(F.col("_enabled"), F.lit(True)).alias("enabled"), *health,
    )
