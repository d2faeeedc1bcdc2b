"""Folding arriving runs into the stored snapshot."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import diff as D
from ..schemas import POSTING
from ..sinks.state import StateStore, append_observations

STATE_SCHEMA = "internal_id string, " + ", ".join(f"{n} {t}" for n, (t, _) in POSTING.items()) + (
    ", first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_changed_at timestamp_ntz, active boolean, "
    "state_version int, last_status string")


def fold_run(current: DataFrame, store: StateStore, run_id: str, run_at, log_root: str | None = None,
             expirable: DataFrame | None = None, write: bool = True) -> DataFrame:
    """Compare a complete run with the stored snapshot, store the next one and
    return the transitions.

    Statuses come from version N before version N+1 exists. The wide join runs
    once, for the snapshot; transitions and log rows are narrow scans of it. A
    stored run is not stored again, only its log rows are made sure of. With
    ``write=False`` nothing is stored.
    """
    at = F.lit(run_at)
    done = store.version_of(run_id)
    if not done or not write:
        version = store.version()
        diff = D.snapshot_diff(current, store.load(STATE_SCHEMA, version), expirable)
        if not write:
            return diff.filter("status is not null").select("internal_id", *D.KEY, "content_hash", "status")
        done = store.commit(D.next_state(diff, at, version + 1), run_id, version + 1)
    out = D.transitions(store.load(version=done), done)
    if log_root:
        append_observations(D.observations(out, F.lit(run_id), at), log_root, run_id)
    return out


def stream_runs(markers: DataFrame, read_run: Callable[[str], DataFrame], store: StateStore, checkpoint: str,
                log_root: str | None = None, incomplete: Callable[[str], DataFrame] | None = None) -> StreamingQuery:
    """Fold every run that a stream of completion markers announces.

    ``incomplete(run_id)`` gives the sources (``source_id``) whose collection
    failed in part; they expire nothing.

    ``markers`` has ``run_id, run_at``, one row per complete run. Expiry needs a
    whole run, so the run's postings are read when its marker arrives, not as
    their files do. Only markers reach the driver.
    """
    def fold(batch: DataFrame, _: int) -> None:
        for marker in batch.select("run_id", "run_at").distinct().orderBy("run_at", "run_id").toLocalIterator():
            if not store.has_run(marker.run_id):  # a repeated marker reads nothing
                current = read_run(marker.run_id)
                whole = None if incomplete is None else D.complete_sources(current, incomplete(marker.run_id))
                fold_run(current, store, marker.run_id, marker.run_at, log_root, whole)

    return (
        markers.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
