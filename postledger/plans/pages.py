"""Watching pages and finding the platform behind careers pages."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import classify
from ..operators import watch as W
from ..schemas import WATCH_STATE
from ..session import cut_lineage
from ..sinks.feed import write_registry
from ..sinks.state import StateStore


def check_watches(pages: DataFrame, watches: DataFrame, store: StateStore, run_id: str) -> DataFrame:
    """Compare fetched pages with the stored ones, store the new state and
    return the outcomes. Page texts are written once; diff and state read them."""
    version = store.version()
    state = store.load(WATCH_STATE, version)
    texts = cut_lineage(W.page_texts(pages.join(watches.select("id"), "id", "left_semi")))
    diff = cut_lineage(W.watch_diff(texts, state))
    if not store.has_run(run_id):
        store.commit(W.next_watch_state(diff, state), run_id, version + 1)
    return W.watch_results(diff, watches)


def discover(companies: DataFrame, pages: DataFrame, probes: DataFrame, path: str | None = None,
             min_confidence: float = 0.0) -> DataFrame:
    """Outcome of source discovery for every company; written when a path is given."""
    found = classify.classify_pages(pages, min_confidence)
    outcomes = classify.discovery_report(companies, found, classify.probe_outcome(probes))
    if path:
        write_registry(outcomes, path)
    return outcomes
