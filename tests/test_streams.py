import datetime as dt
import random

from pyspark.sql import functions as F

from postledger.operators import validate
from postledger.sinks.state import KeyedStore, StateStore
from postledger.streaming import counts, keyed

ARRIVALS = "internal_id string, observed_at timestamp, seq long, content_hash string, closed boolean"
T0 = dt.datetime(2024, 5, 1)


def test_batches_read_and_write_only_their_parts(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "state"), "internal_id", 16)
    rng = random.Random(1)
    last, want, rows = {}, {}, []
    for n in range(3):
        batch = []
        for k in range(40 if n == 0 else 2):
            key = f"p{rng.randrange(30)}"
            batch.append((key, T0 + dt.timedelta(hours=n, minutes=k), n * 100 + k, rng.choice("ab"), rng.random() < 0.2))
        rows.append(batch)
    for batch in rows:
        spark.createDataFrame(batch, ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ARRIVALS).parquet(str(tmp_path / "in"))
        keyed.stream_status(stream, store, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        for key, _, seq, content, closed in batch:
            before = last.get(key)
            want[seq] = ("expired" if closed else "new" if before is None else "reopened" if before[1]
                         else "unchanged" if before[0] == content else "changed")
            last[key] = content, closed
    got = {r.seq: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    whole = store.load(keyed.ARRIVAL_STATE)
    assert {r.internal_id: (r.content_hash, r.closed) for r in whole.collect()} == last
    sizes = [len(store.written(n)) for n in range(3)]
    assert sizes[0] > 10 and 1 <= sizes[1] <= 2 and 1 <= sizes[2] <= 2
    # a batch that comes again reads the parts as they were before it
    early = store.load(keyed.ARRIVAL_STATE, before=1)
    assert early.filter("seq >= 100").count() == 0 and early.count() == len({r[0] for r in rows[0]})
    assert store.load(keyed.ARRIVAL_STATE, before=0).count() == 0


def test_closed_and_open_windows_and_late_rows_are_all_rows(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    rng = random.Random(2)
    mark, expected_late, total = None, 0, 0
    schema = "observed_at timestamp, status string"
    for n in range(4):
        rows = [(T0 + dt.timedelta(days=2 * n, hours=rng.randrange(-60 if n else 0, 48), minutes=rng.randrange(60)), rng.choice(["new", "changed", None])) for _ in range(50)]
        rows.append((None, "new"))
        total += len(rows)
        expected_late += sum(t is None or mark is not None and t.replace(hour=0, minute=0) + dt.timedelta(days=1) <= mark for t, _ in rows)
        mark = max([t - dt.timedelta(hours=2) for t, _ in rows if t] + ([mark] if mark else []))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        counts.stream_counts_and_late_rows(log, store, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    late = spark.read.parquet(str(tmp_path / "out/late"))
    closed = spark.read.parquet(str(tmp_path / "out/windows"))
    still_open = store.load(counts.OPEN_WINDOWS).filter("status is not null")
    assert late.count() == expected_late > 10
    number = lambda df: df.agg(F.sum("observations")).first()[0] or 0
    assert number(closed) + number(still_open) + late.count() == total
    # no window is closed twice, and none that is closed is still open
    assert closed.groupBy("window_start", "status").count().filter("count > 1").count() == 0
    assert closed.select("window_start").intersect(still_open.select("window_start")).count() == 0
    none = lambda s: spark.createDataFrame([], s)
    found = validate.warnings(none("company_id string, source_type string, warning string"), none("company_id string, source_type string, warning string"),
                              none("source_id string, reject_reason string"), late=late).collect()
    assert {r.kind for r in found} == {"late rows"} and sum(int(r.warning.split()[0]) for r in found) == expected_late
    assert any(r.subject == "no time" for r in found)
