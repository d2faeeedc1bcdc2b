"""Record feeds: order, size limits, batches and message texts."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import in_inventory, reportable_watch
from ..functions.records import MAX_DESCRIPTION_CHARS, job_record, record_bytes, watch_record
from ..session import cut_lineage
from .ordering import ROWS_PER_BLOCK, global_positions

# --- fixed values: message limits ---------------------------------------------------
MAX_BODY_BYTES = 90_000
MAX_JOBS = 400
HEADER_RESERVE = 2000
MIN_BUDGET = 1000
MESSAGE_TITLE = "POSTING REPORT"
# -------------------------------------------------------------------------------------

MAPS_PER_GROUP = 256


def feed_order(include: str = "delta") -> list[Column]:
    """New before changed, then company and title; a full inventory is ordered by
    company and title. The id makes the order total."""
    tail = [F.col("company_name"), F.col("title"), F.col("internal_id")]
    return tail if include == "all" else [F.col("status") != "new", *tail]


def _run_status(postings: DataFrame) -> Column:
    """Status given by this run; in a whole snapshot, null for postings that the run did not touch."""
    return F.when(F.col("touched"), F.col("status")) if "touched" in postings.columns else F.col("status")


def feed_records(postings: DataFrame, include: str = "delta", max_chars: int = MAX_DESCRIPTION_CHARS) -> DataFrame:
    """Selected postings with their record text and its size."""
    chosen = postings.filter(in_inventory(_run_status(postings), include, F.col("active") if "active" in postings.columns else None))
    return chosen.select(
        "internal_id", "status", "company_name", "title", job_record(max_chars).alias("record"),
    ).withColumn("bytes", record_bytes(F.col("record")))


def fit_message(records: DataFrame, include: str = "delta", max_jobs: int = MAX_JOBS,
                max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Leading records that fit one message; the first always does.

    The record cap is part of the feature, so the candidates are a top-k of
    ``max_jobs`` rows and the running sum sees no more than that.
    """
    order = feed_order(include)
    top = records.orderBy(*order).limit(max_jobs)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("rank"),
                       F.sum("bytes").over(running).alias("used"))
    return sized.filter((F.col("rank") == 1) | (F.col("used") <= max_bytes))


def batch_budget(max_bytes: int = MAX_BODY_BYTES) -> int:
    return max(max_bytes - HEADER_RESERVE, MIN_BUDGET)


def pack_batches(sized: DataFrame, order: list[Column], max_bytes: int = MAX_BODY_BYTES, max_jobs: int = MAX_JOBS,
                 rows_per_chunk: int = ROWS_PER_BLOCK) -> DataFrame:
    """Batch number of every record under next-fit packing, for feeds of any size.

    ``sized`` has ``internal_id``, ``bytes`` and the columns of ``order``. A batch
    closes when the next record would exceed the budget or when it has
    ``max_jobs`` records, so where it starts depends on all earlier records. To
    split that walk, positions are cut into chunks of fixed length. At a chunk
    border the open batch started within the last ``max_jobs`` records, so each
    chunk is summarised by a small table: open batch on entry -> open batch on
    exit. These tables are chained, in groups, to find the true entry of each
    chunk; then all chunks are numbered at once.
    """
    if rows_per_chunk < max_jobs:
        raise ValueError("rows_per_chunk must be at least max_jobs")
    budget = batch_budget(max_bytes)
    n = sized.count()
    placed = global_positions(sized, order, F.col("bytes"), rows_per_chunk, n)
    chunks = max(1, math.ceil(n / rows_per_chunk))
    narrow = placed.select("internal_id", "pos", "bytes")
    number = _numbering(budget, max_jobs, rows_per_chunk)
    schema = "internal_id string, pos long, batch long"
    narrow = cut_lineage(narrow)
    own = F.floor(F.col("pos") / rows_per_chunk)
    # the tail of a chunk is repeated at the head of the next one
    tail = (F.col("pos") % rows_per_chunk >= rows_per_chunk - max_jobs) & (own + 1 < chunks)
    spread = narrow.withColumn(
        "chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    tables = cut_lineage(
        spread.select("chunk", "pos", "bytes").groupBy("chunk").applyInPandas(
            _chunk_table(budget, max_jobs, rows_per_chunk), "chunk long, entry long, exit long, starts long")
    )
    entries = _true_entries(tables, chunks)
    return spread.join(entries, "chunk").groupBy("chunk").applyInPandas(number, schema)


def _next_start():
    """Index after the last record of the batch that starts at each index."""
    def run(sizes, budget, max_jobs):
        import numpy as np

        total = np.cumsum(sizes)
        at = np.arange(len(sizes))
        reach = np.searchsorted(total, total - sizes + budget, side="right")
        return np.maximum(at + 1, np.minimum(reach, at + max_jobs))

    return run


def _chunk_table(budget: int, max_jobs: int, length: int):
    next_start = _next_start()

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        chunk = int(pdf["chunk"].iloc[0])
        pos = pdf["pos"].to_numpy()
        follow = next_start(pdf["bytes"].to_numpy(), budget, max_jobs).tolist()
        size = len(follow)
        leave, starts = list(range(size)), [0] * size
        for i in range(size - 1, -1, -1):
            j = follow[i]
            if j < size:
                leave[i], starts[i] = leave[j], starts[j] + 1
        if chunk == 0:
            return pd.DataFrame({"chunk": [0], "entry": [-1], "exit": [int(pos[leave[0]])], "starts": [starts[0] + 1]})
        head = int(np.searchsorted(pos, chunk * length))
        return pd.DataFrame({"chunk": chunk, "entry": pos[:head], "exit": pos[leave[:head]], "starts": starts[:head]})

    return run


def _numbering(budget: int, max_jobs: int, length: int):
    next_start = _next_start()

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        first = int(pdf["chunk"].iloc[0]) * length
        entry, base = int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0])
        pos = pdf["pos"].to_numpy()
        follow = next_start(pdf["bytes"].to_numpy(), budget, max_jobs)
        i = 0 if entry < 0 else int(np.searchsorted(pos, entry))
        batch = base + 1 if entry < 0 else base
        out = np.empty(len(pos), dtype="int64")
        while i < len(pos):
            out[i:follow[i]] = batch
            i, batch = int(follow[i]), batch + 1
        own = pos >= first
        return pd.DataFrame({"internal_id": pdf["internal_id"].to_numpy()[own], "pos": pos[own], "batch": out[own]})

    return run


def _true_entries(tables: DataFrame, chunks: int) -> DataFrame:
    """Open batch and its number at the start of each chunk.

    A group chains at most ``MAPS_PER_GROUP`` tables of at most ``max_jobs`` rows.
    With more chunks, groups are first summarised by tables of the same form.
    """
    def steps(pdf):
        by_chunk = {}
        for c, e, x, s in zip(pdf["chunk"], pdf["entry"], pdf["exit"], pdf["starts"]):
            by_chunk.setdefault(int(c), {})[int(e)] = (int(x), int(s))
        return sorted(by_chunk.items())

    def walk(pdf):
        import pandas as pd

        entry, base = int(pdf["from_entry"].iloc[0]), int(pdf["from_base"].iloc[0])
        rows = []
        for c, table in steps(pdf):
            rows.append((c, entry, base))
            entry, more = table[entry]
            base += more
        return pd.DataFrame(rows, columns=["chunk", "entry", "base"])

    def summarise(pdf):
        import pandas as pd

        chain = steps(pdf)
        rows = []
        for start in chain[0][1]:
            at, total = start, 0
            for _, table in chain:
                at, more = table[at]
                total += more
            rows.append((int(pdf["super"].iloc[0]), start, at, total))
        return pd.DataFrame(rows, columns=["chunk", "entry", "exit", "starts"])

    group = F.floor(F.col("chunk") / MAPS_PER_GROUP)
    grouped = tables.withColumn("super", group)
    if chunks <= MAPS_PER_GROUP:
        begun = grouped.withColumns({"from_entry": F.lit(-1).cast("long"), "from_base": F.lit(-1).cast("long")})
    else:
        above = cut_lineage(grouped.groupBy("super").applyInPandas(
            summarise, "chunk long, entry long, exit long, starts long"))
        known = _true_entries(above, math.ceil(chunks / MAPS_PER_GROUP)).select(
            F.col("chunk").alias("super"), F.col("entry").alias("from_entry"), F.col("base").alias("from_base"))
        begun = grouped.join(known, "super")
    return begun.groupBy("super").applyInPandas(walk, "chunk long, entry long, base long")


def message_header(generated_at: Column, counts: Column, part: Column, total_parts: Column, included: Column,
                   omitted: Column, reason: Column, watches_checked: Column, watches_changed: Column,
                   title: str = MESSAGE_TITLE) -> Column:
    """Header lines of one message. Records left out of the whole feed are always stated."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    return F.concat_ws(
        "\n",
        F.lit(f"=== {title} ==="),
        F.concat(F.lit("generated_at: "), F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
        *[line(name, counts[name]) for name in ("total_active", "new", "changed", "expired", "failed_sources")],
        F.concat(F.lit("part: "), part.cast("string"), F.lit(" of "), total_parts.cast("string")),
        line("records_included", included),
        F.when(omitted > 0, F.concat(
            F.lit("records_omitted: "), omitted.cast("string"), F.lit(" ("), reason,
            F.lit("; ordered new-first, so omitted records are the lowest priority)"))),
        line("watches_checked", watches_checked),
        line("watches_changed", watches_changed),
        F.lit(""),
    )


def _message_rows(jobs: DataFrame, postings: DataFrame, watches: DataFrame, generated_at: Column, total_parts: Column,
                  omitted: Column, reason: Column, failed_sources: int) -> DataFrame:
    """Rows of all messages from job rows ``(part, pos, record)``.

    A message is its rows in the order of ``section, pos, key``: header, watched
    pages (first message only, ahead of the postings), postings, footer. No text
    is gathered into one value, so neither a long watch list nor a large part
    meets in one row.
    """
    active = F.col("active") if "active" in postings.columns else F.col("status") != "expired"
    # counts come from one pass over the narrow columns of each input
    counts = postings.agg(F.struct(
        F.count_if(active).alias("total_active"),
        *[F.count_if(_run_status(postings) == s).alias(s) for s in ("new", "changed", "expired")],
        F.lit(failed_sources).alias("failed_sources"))).scalar()
    seen = watches.agg(F.struct(F.count("*").alias("checked"), F.count_if(F.col("status") == "changed").alias("changed"))).scalar()
    first = F.col("part") == 1
    parts = jobs.groupBy("part").agg(F.count("*").alias("n"))
    header = message_header(
        generated_at, counts, F.col("part"), total_parts, F.col("n"), omitted, reason,
        F.when(first, seen["checked"]).otherwise(F.lit(0)), F.when(first, seen["changed"]).otherwise(F.lit(0)))
    row = lambda section, pos, key, text: (
        F.lit(section).alias("section"), pos.cast("long").alias("pos"), key.alias("key"), text.alias("text"))
    none = F.lit("")
    shown = watches.filter(reportable_watch(F.col("status")))
    return (
        parts.select("part", *row(0, F.lit(0), none, header))
        .unionByName(shown.select(F.lit(1).cast("long").alias("part"), *row(1, F.lit(0), F.col("id"), watch_record())))
        .unionByName(jobs.select("part", *row(2, F.col("pos"), none, F.col("record"))))
        .unionByName(parts.select("part", *row(3, F.lit(0), none, F.lit("=== END REPORT ==="))))
    )


def single_message(postings: DataFrame, watches: DataFrame, generated_at: Column, include: str = "delta",
                   max_jobs: int = MAX_JOBS, max_bytes: int = MAX_BODY_BYTES, failed_sources: int = 0,
                   max_chars: int = MAX_DESCRIPTION_CHARS) -> DataFrame:
    """The one message of a daily run: the records that fit, the rest counted."""
    records = feed_records(postings, include, max_chars)
    kept = fit_message(records, include, max_jobs, max_bytes).select(
        F.lit(1).cast("long").alias("part"), F.col("rank").alias("pos"), "record")
    omitted = records.agg(F.count("*")).scalar() - F.col("n")
    reason = F.when(F.col("n") >= max_jobs, F.lit("record cap")).otherwise(F.lit("body size limit"))
    return _message_rows(kept, postings, watches, generated_at, F.lit(1), omitted, reason, failed_sources)


def batch_messages(postings: DataFrame, watches: DataFrame, generated_at: Column, include: str = "all",
                   max_parts: int | None = None, max_bytes: int = MAX_BODY_BYTES, max_jobs: int = MAX_JOBS,
                   failed_sources: int = 0, max_chars: int = MAX_DESCRIPTION_CHARS,
                   rows_per_chunk: int = ROWS_PER_BLOCK) -> DataFrame:
    """A whole feed as numbered messages. Only ids and sizes are ordered
    globally; texts join their batch by id. With ``max_parts`` only the first
    messages are made; each states the true number of parts and the records
    that no message has."""
    records = feed_records(postings, include, max_chars)
    batches = pack_batches(records.drop("record"), feed_order(include), max_bytes, max_jobs, rows_per_chunk)
    batches = cut_lineage(batches)
    total = batches.agg(F.max("batch") + 1).scalar()
    omitted = F.lit(0)
    if max_parts is not None:
        omitted = batches.agg(F.count_if(F.col("batch") >= max_parts)).scalar()
        batches = batches.filter(F.col("batch") < max_parts)
    jobs = records.join(batches, "internal_id").select((F.col("batch") + 1).alias("part"), "pos", "record")
    return _message_rows(jobs, postings, watches, generated_at, total, omitted, F.lit("part limit"), failed_sources)


def message_bodies(rows: DataFrame) -> DataFrame:
    """One text per message, for delivery: a message holds at most ``max_jobs``
    records, and the first one also the watched pages that changed."""
    listed = F.array_sort(F.collect_list(F.struct("section", "pos", "key", "text")))
    return rows.groupBy("part").agg(
        F.count_if(F.col("section") == 2).alias("records"),
        F.array_join(F.transform(listed, lambda r: r["text"]), "\n").alias("body"))


def covered(postings_in_feed: DataFrame, batches: DataFrame, max_parts: int) -> DataFrame:
    """One row: records offered, sent and left out by a limit on messages."""
    sent = batches.agg(F.count_if(F.col("batch") < max_parts)).scalar()
    return postings_in_feed.agg(F.count("*").alias("offered")).select(
        "offered", sent.alias("sent"), (F.col("offered") - sent).alias("omitted"))
