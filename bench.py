"""Time the headline queries. Prints one JSON line.

The given tables are one file with one row group each, which one task reads. They
are dealt out to as many files as there are cores before anything is timed.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, optional).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postledger.session import build_session, remove_shared, shared_folder  # noqa: E402
from postledger.workload import QUERIES  # noqa: E402

HEADLINE = (
    "snapshot_diff", "run_statistics", "merge_state", "latest_status", "recent_postings", "source_health",
    "content_hash", "fingerprint", "location_filter", "page_text", "clean_html", "job_records",
    "feed_prefix", "feed_batches", "feed_parts", "duplicate_links", "best_duplicates", "duplicate_groups",
    "decode_greenhouse", "decode_lever", "decode_ashby", "decode_workday", "decode_jsonld",
    "watch_diff", "classify_pages", "stream_status",
)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
    })

    dealt = f"{shared_folder(spark)}/tables"
    for table in TABLES:
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(int(cpus)).write.parquet(f"{dealt}/{table}.parquet")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, dealt).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # each query runs twice: the first run loads classes and compiles code
    times = {name: round(min(run(name), run(name)), 3) for name in names}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    remove_shared(spark)
    spark.stop()


if __name__ == "__main__":
    main()
