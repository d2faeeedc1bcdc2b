"""The daily work from stored responses to state, reports and messages."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import LocationFilter, SearchRule, matching_rules
from ..operators import diff as D
from ..functions.text import source_id
from ..operators import feed, report, rollups
from ..operators.validate import warnings
from ..session import cut_and_count, cut_lineage
from ..sinks.feed import write_messages
from ..sinks.report import archive_report, write_json_report, write_markdown_report
from ..sinks.state import StateStore
from ..sources.landing import accepted, attach_options, judged, rejected, unreadable_responses
from ..sources.registry import enabled_sources
from ..sources.union import decode_all
from ..sources.workday import detail_cap_warnings, search_completeness, search_summaries
from ..streaming.runs import fold_run

STORED_COMPANY = "id string, name string, enabled boolean, priority string, created_at timestamp_ntz, updated_at timestamp_ntz"


def collect(landing: DataFrame, companies: DataFrame, sources: DataFrame, store: StateStore, run_id: str,
            run_at: datetime, where: LocationFilter | None = None, rules: tuple[SearchRule, ...] = (),
            log_root: str | None = None, retain_raw: bool = False, gate_incomplete: bool = True,
            write: bool = True, registry: StateStore | None = None) -> dict[str, DataFrame]:
    """One run: decode, filter by place, compare, store, count.

    Responses get the options of their source. Decoded postings are written
    once, because the comparison and the source roll-up both read
    them; what the place filter keeps and drops is counted during that write. ``diff`` holds the transitions. Places are filtered before the
    comparison, so that out-of-area postings never expire later. Sources with a
    short search, or any failed or unreadable response other than a detail page, expire
    nothing. With ``registry`` the companies of the configuration are merged
    into the stored ones. The result also has the run's warnings and log row.
    """
    scope = enabled_sources(companies, sources)
    wanted = attach_options(landing.join(scope.select("company_id", F.col("type").alias("source_type")).distinct(),
                                         ["company_id", "source_type"], "left_semi"), scope)
    # roll-ups, the expiry gate and warnings read responses without bodies
    seen = cut_lineage(judged(wanted))
    keep = F.lit(True) if where is None else where.matches(F.col("location"))
    good = F.col("reject_reason").isNull()
    decoded, n = cut_and_count(decode_all(wanted, where=where, retain_raw=retain_raw), kept=F.count_if(good & keep), dropped=F.count_if(good & ~keep))
    found = accepted(decoded)
    names = matching_rules(rules, F.col("title"), F.col("location"))
    current = D.last_in_run(
        found.filter(keep).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.get(names, 0), F.lit(""))),
        F.col("ingest_order")).drop("ingest_order")
    completeness = cut_lineage(search_completeness(wanted))
    expirable = D.complete_sources(current, incomplete_sources(seen, completeness)) if gate_incomplete else None
    diff = fold_run(current, store, run_id, run_at, log_root, expirable, write)
    if registry is not None and write and not registry.has_run(run_id):
        version = registry.version()
        merged = D.merge_companies(registry.load(STORED_COMPANY, version), companies, F.lit(run_at))
        registry.commit(merged, run_id, version + 1)
    runs = rollups.source_runs(seen, found)
    statistics = rollups.run_statistics(diff)
    stats = rollups.collection_stats(scope, runs, statistics)
    refused, unread = rejected(decoded), unreadable_responses(seen)
    at = F.lit(run_at)
    return {
        "diff": diff, "postings": current, "rejected": refused, "unreadable": unread, "source_runs": runs,
        "source_errors": rollups.source_errors(seen), "filter_effect": landing.sparkSession.createDataFrame([(n["kept"], n["dropped"])], "kept long, dropped long"),
        "statistics": statistics, "stats": stats, "run_log": rollups.run_log_row(stats, run_id, at, at),
        "warnings": warnings(completeness, detail_cap_warnings(search_summaries(wanted), where), refused, unreadable=unread),
    }


def incomplete_sources(landing: DataFrame, completeness: DataFrame) -> DataFrame:
    """Sources of which the run may lack postings: short searches, failed and unreadable responses."""
    short = completeness.filter("found < total").select(source_id(F.col("company_id"), F.col("source_type")).alias("source_id"))
    return short.unionByName(rollups.response_errors(landing).select("source_id")).distinct()


def postings_of_run(store: StateStore, version: int | None = None) -> DataFrame:
    """Postings that a run touched, expired ones included, ready for reports."""
    return inventory(store, version).filter("touched")


def inventory(store: StateStore, version: int | None = None) -> DataFrame:
    """The whole snapshot after a run: what a full inventory publishes, and what totals count."""
    v = store.version() if version is None else version
    return D.inventory(store.load(version=v), v)


def publish(postings: DataFrame, watches: DataFrame, stats: DataFrame, errors: DataFrame, at: datetime, path: str,
            include: str = "delta", max_messages: int = 1) -> None:
    """Write the reports, their dated copy and the messages.

    ``postings`` is the inventory; reports show what the run touched, messages
    either that or, with ``include="all"``, every active posting.
    """
    s = stats.first()  # one row of counts
    generated = F.lit(at).cast("timestamp_ntz")
    touched = postings.filter("touched") if "touched" in postings.columns else postings
    write_json_report(touched, report.json_header(generated, stats), errors, f"{path}/latest_jobs")
    lines = report.markdown_rows(touched, generated, s.source_count, s.successful_sources, s.failed_sources, errors)
    write_markdown_report(lines, f"{path}/latest_report")
    archive_report(lines, f"{path}/archive", generated)
    if max_messages > 1:
        messages = feed.batch_messages(postings, watches, generated, include, max_messages, failed_sources=s.failed_sources)
    else:
        messages = feed.single_message(postings, watches, generated, include, failed_sources=s.failed_sources)
    write_messages(messages, f"{path}/messages")
